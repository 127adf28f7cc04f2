"""Parts of the training-data operators: formats, exactness of filters, general interfaces."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import ann, common, components, decontaminate, langid, linededup, lm, mixing, pii, simhash, tokencount, warc
from millrace.llm.common import put_file, work_dir
from pyspark.sql import functions as F

from . import plain


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE89370400440532013001")


def test_context_words_decide_what_has_no_checksum():
    assert not [s for s in pii.spans_of("number 123-45-6789 here") if s[0] == "ssn"]
    assert [s for s in pii.spans_of("social security 123-45-6789") if s[0] == "ssn"]


def test_digits_of_any_length_are_no_address():
    assert pii.spans_of("0" * 5000 + ".0.0.1")[0][:3] == ("ip", 0, 5006)
    assert not [s for s in pii.spans_of("1" * 5000 + ".0.0.1") if s[0] == "ip"]


def test_ibans_end_with_their_country_s_length():
    assert [s[:3] for s in pii.spans_of("IBAN DE89 3704 0044 0532 0130 00 AND MORE")] == [("iban", 5, 32)]
    assert not [s for s in pii.spans_of("IBAN DE89 3704 0044 0532 0130 0012") if s[0] == "iban"]


def test_context_words_are_whole_words():
    assert pii.spans_of("we ship it 123-45-6789 by taxi") == []
    assert [s[3] for s in pii.spans_of("ip 1.2.3.4")] == [0.8] and [s[3] for s in pii.spans_of("ship 1.2.3.4")] == [0.6]


def test_secrets_need_entropy_and_context_or_a_prefix():
    run = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"
    assert [s[0] for s in pii.spans_of(f'token = "{run}" end')] == ["secret"]
    assert pii.spans_of(f"commit {run} of today") == []
    assert pii.spans_of("token = " + "a1" * 20) == []
    assert [s[0] for s in pii.spans_of("x ghp_0aB1cD2eF3gH4iJ5kL6mN7oP8qR9sT0uV1wX y")] == ["secret"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@-_ é\n", max_size=60))
def test_emails_equal_a_plain_search(text):
    import re

    assert pii.emails(text) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_rotation_keeps_lengths():
    r = ann.rotation(16)
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-5)


def test_scan_abandons_nothing_among_the_nearest():
    rng = np.random.default_rng(1)
    raw = rng.standard_normal((500, 32))
    x = ann.unit(raw) @ ann.rotation(32)
    right = 0
    for i, ids, score in ann.scan_slice(np.arange(500), x, raw, x[:50], raw[:50], 6, 8, 2.1):
        s = ann.cosines(raw[i], raw)
        right += len(set(ids.tolist()) & set(np.argsort(-s)[:6].tolist()))
        assert np.array_equal(score, s[ids])
    assert right >= 0.95 * 300


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(1, 9))])
    group = np.sort(rng.integers(0, 3, len(fp)))
    for radius in (0, 3, 4, 6, 7, 18, 30):
        got = {(min(a, b), max(a, b)) for x, y in simhash.links_of(fp, group, np.zeros(len(fp), bool), np.ones(len(fp), bool), radius) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        want = {(i, j) for j in range(len(fp)) for i in range(j) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
        assert got == want


def test_sliced_buckets_lose_no_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def groups(edges):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return sorted(sorted(x for x in signed if find(x) == r) for r in {find(x) for x in signed})

    want = groups([(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    for rows in (8, 100000):
        assert groups([tuple(r) for r in simhash.links(df, 4, rows).collect()]) == want
    assert groups([tuple(r) for r in simhash.links(df, 4, bands=simhash.masks(4, 10**8)).collect()]) == want


def test_closest_forest():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b, far = rng.integers(0, 40, 60), rng.integers(0, 40, 60), rng.integers(0, 9, 60)
        kept = simhash.closest_forest(40, a, b, far)
        root, length, count = list(range(40)), 0, 0
        for d, x, y in sorted(zip(far.tolist(), a.tolist(), b.tolist(), strict=True)):  # Kruskal
            if root[x] != root[y]:
                length, count = length + d, count + 1
                root = [root[y] if r == root[x] else r for r in root]
        assert len(kept) == count and far[kept].sum() == length
        assert np.array_equal(simhash.forest(40, a[kept], b[kept]), simhash.forest(40, a, b))


def test_keep_one_of_similar_documents(spark):
    rng = random.Random(6)

    def text(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    rows = []
    for n in (6, 30, 120, 120, 400, 900):
        base = text(n)
        rows += [" ".join(base), " ".join(base).upper(), " \n".join(base)]
        for changes in (1, 2, 4, 8, 16, 30):
            for _ in range(4):
                words = list(base)
                for at in rng.sample(range(n), min(changes, n // 3)):
                    words[at] = f"x{rng.randrange(5000)}"
                rows.append(" ".join(words))
        rows.append(" ".join(base[: n * 9 // 10]))
        rows.append(" ".join(base + text(n // 2)))
    rows += ["", None, "one", "One", "one two", "spam " * 50, "spam " * 300, "spam " * 300 + "and then some more words follow here"]
    rng.shuffle(rows)
    sets = [plain.shingles(t, 5) for t in rows]
    least = list(range(len(rows)))
    for j, y in enumerate(sets):
        for i in range(j):
            if len(sets[i] & y) >= 0.8 * len(sets[i] | y) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if r == high else r for r in least]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(least))
    nodes = simhash.sketches(df.withColumnRenamed("doc_id", "id")).dropDuplicates(["node"]).withColumn("root", F.col("node"))
    whole, sliced = ({(r.a, r.b) for r in simhash.similar_links(nodes, 0.8, 20, 1000, None, k).collect() if r.g is None} for k in (8192, 8))
    assert whole == sliced and len(whole) > 100


def test_a_dense_group_of_pairs_just_under_the_similarity_makes_no_row_for_each(spark, monkeypatch):
    rows, base = [], [f"w{k}" for k in range(84)]  # 80 shingles; one other word changes five of them
    for at in range(4, 84, 5):
        for k in range(12):  # with the same place 0.88, with another 0.78
            rows.append((len(rows), " ".join([*base[:at], f"x{at}y{k}", *base[at + 1 :]])))
    made, write = {}, simhash.staged

    def spy(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "staged", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(0, len(rows), 12))
    assert made["simhash-links"] + made["simhash-pairs"] + made.get("simhash-rest", 0) <= 2 * simhash.KEYS * len(rows) + 1000


def test_confirmed_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    hashes = [np.unique(rng.choice(400, 40)) for _ in range(6)]
    hashes = [np.unique(np.r_[rng.choice(h, len(h) - rng.integers(1, 9), False), rng.choice(400, 3)]).astype(np.int32) for h in hashes for _ in range(12)]
    n, root = len(hashes), np.arange(len(hashes)) // 2 * 2  # neighbours are one already
    x, y = np.triu_indices(n, 1)
    near = np.array([len(np.intersect1d(hashes[i], hashes[j])) >= 0.7 * len(np.union1d(hashes[i], hashes[j])) for i, j in zip(x, y, strict=True)])
    want = simhash.forest(n, np.r_[x[near], np.arange(n)], np.r_[y[near], root])
    sets = simhash.Sets(np.concatenate(hashes), np.cumsum(list(map(len, hashes))))
    for at_once in (1, 1 << 20):
        a, b = simhash.confirmed_forest(sets, root, ((x[k : k + 99], y[k : k + 99]) for k in range(0, len(x), 99)), 0.7, at_once)
        assert np.array_equal(simhash.forest(n, np.r_[a, np.arange(n)], np.r_[b, root]), want) and len(a) == n // 2 - len(np.unique(want)) > 0


def test_masks_leave_no_pair_out():
    assert [len(simhash.masks(4, n)) for n in (10, 10**8, 10**10, 10**13)] == [5, 15, 35, 70]
    rng = random.Random(5)
    for n in (10, 10**8, 10**10):
        under = simhash.masks(4, n)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
            assert any(a & m == b & m for m in under)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_token_scan_of_files_cut_anywhere(spark, monkeypatch):
    rng, folder, want, files = random.Random(4), work_dir(spark, "scan"), {}, []
    for k, closed in enumerate((True, False, True)):
        lens = [rng.choice([0, 0, 1, 3, 50]) for _ in range(40)] if k < 2 else []
        ids = []
        for i, n in enumerate(lens):
            ids += [rng.randrange(50) for _ in range(n)] + ([99] if closed or i < len(lens) - 1 else [])
        put_file(f"{folder}/{k}.u16", [np.array(ids, "<u2").tobytes()])
        files.append((f"{folder}/{k}.u16", 2 * len(ids)))
        want |= {(k, i): n for i, n in enumerate(lens) if closed or i < len(lens) - 1 or n}
    df = spark.createDataFrame(files, "file string, bytes long")
    monkeypatch.setattr(tokencount.stitch, "__defaults__", (4,))  # groups of four blocks
    for block in (1, 7, 64, 100000):
        got = {(int(r.file[-5]), r.ordinal): r.n_tokens for r in tokencount.scan(df, eod=99, block=block).collect()}
        assert got == want
    assert tokencount.token_files(spark, folder).count() == 2  # the listing leaves out files without bytes, which hold no document


def test_one_record_is_read_from_its_frame(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 20}</p>" * 50) for i in range(60)], "page_id long, url string, html string")
    rows = warc.write_archive(pages, work_dir(spark, "warc"), frame_bytes=4000, bundle_bytes=3000).collect()
    assert len({r.bundle for r in rows}) > 1 and max(r.frame for r in rows) > 0
    for r in rows[::7]:
        head, block = warc.read_record(r)
        assert head["WARC-Record-ID"] == r.record_id and head["X-Page-ID"] == str(r.page_id)
        assert block.endswith(b"</p>") == (head["WARC-Type"] == "response")
        assert head["WARC-Type"] == ("response" if r.page_id < 20 else "revisit")


def test_frames_are_independent_and_the_footer_is_skippable():
    import zstandard

    plain = [b"a" * 1000, b"b" * 10]
    frames = [zstandard.compress(p) for p in plain]
    data = b"".join(frames) + warc.seek_table([(len(f), len(p)) for f, p in zip(frames, plain, strict=True)])
    import io

    table = warc.frames_of(io.BytesIO(data), len(data))
    assert [zstandard.decompress(data[a : a + n]) for a, n, _ in table] == plain
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(plain)


def test_page_ids_of_any_characters_come_back(spark):
    ids = ["", "a\r\nb", "ü/%41", " x ", None]
    pages = spark.createDataFrame([(i, None, f"<p>{i}</p>") for i in ids] + [("z", "u", "<p></p>"), ("zz", "u", "<p></p>")], "page_id string, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()]
    assert sorted(got, key=str) == sorted([(None, "response", None), (" x ", "response", None), ("", "response", None), ("a\r\nb", "response", None), ("z", "revisit", ""), ("zz", "revisit", ""), ("ü/%41", "response", None)], key=str)


def test_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "c", "y" * 100), (3, "d", "y" * 100)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_and_read(pages, min_bytes=50).collect()}
    assert got == {0: ("response", None), 1: ("response", None), 2: ("response", None), 3: ("revisit", 2)}


def test_a_broken_payload_is_noticed(spark):
    pages = spark.createDataFrame([(0, "a", "hello hello")], "page_id long, url string, html string")
    r = warc.write_archive(pages, work_dir(spark, "warc")).first()
    import zstandard

    from millrace.llm.common import open_fs

    fs, path = open_fs(r.bundle)
    with fs.open_input_file(path) as f:
        raw = f.read()
    (at, n, _), = warc.frames_of(__import__("io").BytesIO(raw), len(raw))
    bad = zstandard.decompress(raw[at : at + n]).replace(b"hello hello", b"hello jello")
    frame = zstandard.compress(bad)
    foot = warc.seek_table([(len(frame), len(bad))])
    put_file(r.bundle, [frame, foot])
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark.createDataFrame([(r.bundle, len(frame) + len(foot))], "bundle string, bytes long")).collect()


def test_forward_sums_every_segmentation():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    vocab = {p: i for i, p in enumerate(pieces)}
    prob = np.array([[0.1, 0.3], [0.2, 0.1], [0.05, 0.2], [0.3, 0.1], [0.15, 0.1], [0.1, 0.1], [0.1, 0.1]])
    assert langid.size_of(langid.trie_of(pieces)) == 6
    lat = langid.Lattice([b"ab", b"aba", b"c"], langid.trie_of(pieces), 6)

    def brute(s, k):
        return 1.0 if not s else sum(prob[i, k] * brute(s[len(p) :], k) for p, i in vocab.items() if s.startswith(p)) + (prob[6, k] * brute(s[1:], k) if s[0] not in vocab else 0)

    want = np.log([[brute("▁ab", k) for k in (0, 1)], [brute("▁aba", k) for k in (0, 1)], [brute("▁c", k) for k in (0, 1)]])
    assert np.allclose(lat.forward(prob), want)
    long = langid.Lattice([b"ab" * 30, b"c" * 400, b"ab"], langid.trie_of(pieces), 6)  # beyond the batches, and beyond a double's range
    logs = [{**{p: np.log(prob[i, k]) for p, i in vocab.items()}, None: np.log(prob[6, k])} for k in (0, 1)]
    want = [[plain.segmentations("▁" + "ab" * 30, logs[k], None) for k in (0, 1)], [np.log(prob[0, k]) + 400 * np.log(0.1) for k in (0, 1)], want[0]]
    assert np.allclose(long.forward(prob), want)
    into = np.zeros_like(prob)
    long.expect(prob, np.array([0, 1, 1]), np.array([2.0, 3.0, 1.0]), into)
    for p, n in plain.expected("▁" + "ab" * 30, logs[0], None).items():
        assert into[vocab[p], 0] == pytest.approx(2 * n)
    assert into[6, 1] == pytest.approx(1200)
    into = np.zeros_like(prob)
    lat.expect(prob, np.array([0, 1, 0]), np.array([2.0, 1.0, 3.0]), into)
    assert into[6, 0] == pytest.approx(3.0)  # c is no piece: each of its three occurrences is one unknown
    assert (into[:6] @ np.ones(2) * np.array([1, 1, 1, 2, 2, 2])).sum() == pytest.approx(3 * 2 + 4 * 1 + 2 * 3 - 3)  # characters, the unknown's aside


def some_windows(rng, n, classes, rows):
    z = rng.integers(0, rows, n)
    return lm.Inputs(z, np.array([n]), np.arange(rows, dtype=np.int32), (np.arange(rows) % classes).astype(np.int32), (rows, classes))


def test_attention_gradient():
    rng = np.random.default_rng(5)
    m = lm.Attention(7, 11, dim=5, seed=1)
    m.flat = m.flat.astype(np.float64)
    x = some_windows(rng, 5 * lm.HOP - 4, 7, 11)
    ids, opens, last, target, there = x.some(slice(None))
    loss, g, rows = m.gradient(ids, opens, last, target, there)
    assert loss == pytest.approx(-float((m.log_prob(ids, opens, last, target, np.ones(7, np.float32))[0] * there).sum()) / there.sum(), rel=1e-4)
    flat = np.zeros_like(m.flat)
    for name, view in m.views(flat).items():
        view[rows if name == "e" else ...] = g[name]
    for k in rng.choice(len(m.flat), 60, replace=False):
        old, step = m.flat[k], 1e-3
        m.flat[k] = old + step
        up = m.gradient(ids, opens, last, target, there)[0]
        m.flat[k] = old - step
        down = m.gradient(ids, opens, last, target, there)[0]
        m.flat[k] = old
        assert (up - down) / (2 * step) == pytest.approx(flat[k], abs=2e-3)


def test_windows_score_each_token_once_and_causally():
    lens = [1, lm.HOP, lm.HOP + 1, 5 * lm.HOP + 3]
    z = np.concatenate([np.arange(n) % 5 for n in lens])
    x = lm.Inputs(z, np.array(lens), np.arange(5, dtype=np.int32), np.arange(5, dtype=np.int32), (5, 5))
    assert sorted(x.goal[x.there].tolist()) == list(range(len(z))) and (z[x.goal] == x.target)[x.there].all()
    m, begins = lm.Attention(5, 5), np.ones(5, np.float32)
    a = m.log_prob(x.ids, x.opens, x.last, x.target, begins)[0]
    later, last = x.ids.copy(), x.last.copy()
    later[:, -1] = last[:, -1] = 0  # the last input is seen by the last query only
    assert np.allclose(a[:, :-1], m.log_prob(later, x.opens, last, x.target, begins)[0][:, :-1])
    before = x.ids.copy()
    before[x.opens, : lm.HOP] = 3  # what stands before a text isn't seen
    assert np.array_equal(a, m.log_prob(before, x.opens, x.last, x.target, begins)[0])


def test_a_scored_subword_sees_sixteen_before_it():
    rng = np.random.default_rng(7)
    m = lm.Attention(96, 200)
    assert m.d == 24 and lm.HOP == 16
    z, kinds = rng.integers(0, 200, 64), np.zeros(200, np.int32)
    for k in range(17, 48):
        other = z.copy()
        other[k - 16] = (other[k - 16] + 1) % 200
        x, y = (lm.Inputs(s, np.array([64]), np.arange(200, dtype=np.int32), kinds, (200, 96)) for s in (z, other))
        a, b = (m.log_prob(w.ids, w.opens, w.last, w.target, np.ones(96, np.float32))[0].ravel()[k] for w in (x, y))
        assert a != b


def test_windows_see_their_own_texts_beginning_and_nothing_before_it():
    rng, lens = np.random.default_rng(8), np.array([7, 3 * lm.HOP, 2 * lm.HOP + 5])
    m, own, kinds = lm.Attention(5, 9), np.arange(9, dtype=np.int32), np.arange(9, dtype=np.int32) % 5
    z = rng.integers(0, 9, lens.sum())
    alone = z[lens[0] :][: lens[1]]
    first, x, y = (lm.Inputs(s, n, own, kinds, (9, 5)) for s, n in ((alone, lens[1:2]), (z, lens), (np.append((z[: lens[0]] + 1) % 9, z[lens[0] :]), lens)))
    assert x.ids[x.opens, lm.HOP].tolist() == [9, 9, 9] and x.ids[[2, 5], 0].tolist() == [9, 9]  # also in the second windows of texts, where the first key is the beginning
    logs = [m.log_prob(w.ids, w.opens, w.last, w.target, np.ones(5, np.float32))[0] for w in (first, x, y)]
    assert np.allclose(logs[0], logs[1][1:4], atol=1e-6) and np.array_equal(logs[1][1:], logs[2][1:])


def test_sums_by_key_and_steps_of_some_rows():
    rng = np.random.default_rng(9)
    keys, values = rng.integers(0, 60000, 500) // 900 * 900, rng.standard_normal((500, 24)).astype(np.float32)
    found, sums = lm.summed(keys, values)
    assert found.tolist() == sorted(set(keys.tolist())) and np.allclose(sums, [values[keys == k].sum(axis=0) for k in found], atol=1e-4)
    p, m, v = rng.standard_normal((6, 3)).astype(np.float32), np.zeros((6, 3), np.float32), np.zeros((6, 3), np.float32)
    q, first, second = p.astype(np.float64), m.astype(np.float64), v.astype(np.float64)
    for step, at in enumerate(([0, 2], [2, 5], [0, 5], [2, 3]), 1):
        g = rng.standard_normal((2, 3)).astype(np.float32)
        lm.adam(p, m, v, np.array(at), g, step)
        first[at], second[at] = 0.9 * first[at] + 0.1 * g, 0.98 * second[at] + 0.02 * g * g
        q[at] -= 0.004 / (1 + step / 400) ** 0.5 * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.98**step)) + 1e-8)
    assert np.allclose(p, q, atol=1e-6)


@pytest.fixture(scope="module")
def trained(spark):
    """What a small corpus's model scores with: the speller, the counts of all words, N, the share of known words; texts and scores."""
    rng, seen, score = random.Random(6), [], lm.score_texts
    words = ["the", "of", "river", "unbelievable", "zxqj", "été", "日本", "Straße"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["neverseen the words", "", "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "score_texts", lambda d, speller, hot, n, known, ranks: seen.append((speller, n, known)) or score(d, speller, hot, n, known, ranks))
        got = {r.doc_id: r.score for r in lm.score_corpus(docs, lm.F.col("doc_id") == 60, hot=5).collect()}
    return *seen[0], texts, got


def test_scores_equal_a_plain_scorer(trained):
    import collections
    import math

    speller, n, known, texts, got = trained
    encode = lm.encoder(lm.rank_file())
    p = {k: v.astype(np.float64) for k, v in speller.net.views(speller.net.flat).items()}
    split = [[*t.lower().split(), ""] for t in texts]
    counts = collections.Counter(w for k, t in enumerate(split) if k != 60 for w in t)
    assert n == sum(counts.values()) and known == 1 - (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    begins = lm.beginners(lm.rank_file())
    for k in (0, 1, 7, 60, 61, 62):
        pieces = [encode(b" " + w.encode()) if w else [lm.EOD] for w in split[k]]
        want = plain.spelt(p, 16, speller.net.c, speller.row_of, speller.class_of, speller.log_piece, begins, pieces)
        want = sum(math.log10((1 - known) * math.exp(x) + known * counts[w] / n) for x, w in zip(want, split[k], strict=True))
        assert got[k] == pytest.approx(want, rel=1e-4)


def test_what_may_come_next_sums_to_one(trained):
    speller, n, known, texts, _ = trained
    begins = lm.beginners(lm.rank_file())
    assert all(len(set(begins[speller.class_of == k].tolist())) == 1 for k in range(speller.net.c))  # so one softmax says whether a word ends
    encode = lm.encoder(lm.rank_file())
    for text in (b"", b" the", b" unbelievable zx", b" of" * 30, b" zxqj river"):  # a text's beginning, inside and at the end of words, far on
        before = np.array([z for w in text.split() for z in encode(b" " + w)], np.int64)
        x = lm.Inputs(np.append(before, 0), np.array([len(before) + 1]), speller.row_of, speller.class_of, (speller.net.rows, speller.net.c))
        i = len(before)
        ids, opens, last, _, _ = (v[i // lm.HOP : i // lm.HOP + 1] for v in x.some(slice(None)))
        total, ending, first = 0.0, 0.0, None
        for k in range(speller.net.c):
            lp, ends = (v[0, i % lm.HOP] for v in speller.net.log_prob(ids, opens, last, np.full((1, lm.HOP), k, np.int32), speller.begins))
            mass = np.exp(np.float64(lp)) * np.exp(speller.log_piece[speller.class_of == k].astype(np.float64)).sum()
            total, first = total + mass, np.exp(np.float64(ends))
            ending += mass * speller.begins[k]
        assert total == pytest.approx(1, abs=1e-4)  # over all subwords
        assert ending == pytest.approx(first, rel=1e-3)  # over those that begin a word, what the word before is multiplied by and the next divided
    assert 0 < known < 1  # and words by counts (adding up to one) and by spelling are mixed with known and 1 - known


def test_held_out_words_that_are_known_beat_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_corpus(docs).filter("held_out and n_known = n_tokens").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_the_share_of_the_counts_is_learned(spark, monkeypatch):
    docs, chosen, likeliest = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), [], lm.likeliest

    def spy(done, rare, n, known):
        assert all((r.hot_without is None) == r.held_out for r in done.collect())
        chosen.append(likeliest(done, rare, n, known))
        return chosen[-1]

    monkeypatch.setattr(lm, "likeliest", spy)
    sums = [lm.score_corpus(docs).filter("held_out").agg({"score": "sum", "n_tokens": "sum"}).first()]
    monkeypatch.setattr(lm, "likeliest", lambda *a: len(lm.SHARES) - 1)  # Good and Turing's weight alone
    sums.append(lm.score_corpus(docs).filter("held_out").agg({"score": "sum", "n_tokens": "sum"}).first())
    learned, fixed = (r["sum(score)"] / r["sum(n_tokens)"] for r in sums)
    assert 0 < lm.SHARES[chosen[0]] < 0.95  # the attention model has a say in known words
    assert learned > fixed + 0.02  # and held-out texts are likelier


def test_the_language_model_learns_from_every_subword(spark, monkeypatch):
    seen, learn = [], lm.train_attention

    def spy(taken, class_of, row_of, pairs, *a, **options):
        seen.append((pairs.sum(), sum(len(r.pieces) for r in taken.collect())))
        return learn(taken, class_of, row_of, pairs, *a, **options)

    monkeypatch.setattr(lm, "train_attention", spy)
    texts = [" ".join(f"w{i % 7}" for i in range(n)) for n in (0, 5, 100, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lm.score_corpus(docs, lm.F.lit(False)).count() == 4
    encode = lm.encoder(lm.rank_file(None))
    n = sum(len(lm.pieces_of(encode, w)) for t in texts for w in [*lm.words_of(t), b""])
    assert seen == [(n, 2 * (n + len(texts)))]  # 16 bits each, and one for each text's beginning


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "d c b a x x a b"), (2, "a x b x c"), (3, None), (4, "A-B; c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c"), (8, "zz")], "item_id long, text string")
    for options in ({}, {"segment_tokens": 4}, {"block_words": 1, "segment_tokens": 9}):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items, **options).collect()}
        assert got == {0: (6, 3, ["7"]), 1: (8, 0, []), 2: (5, 0, []), 3: (0, 0, []), 4: (3, 3, ["7"])}
    near = {r.doc_id: r["items"] for r in decontaminate.contamination(docs, items, span=4).collect()}
    assert near == {0: ["7"], 1: ["7"], 2: ["7"], 3: [], 4: ["7"]}


def test_an_index_segment_is_built_from_numbers_not_words():
    n, rng = 1 << 17, random.Random(5)
    words = [f"passage{rng.randrange(3000)}" for _ in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n // 256)), "text": [" ".join(words[i : i + 256]) for i in range(0, n, 256)]})
    list(decontaminate.segments([batch], n))  # imports
    tracemalloc.start()
    try:
        (row,) = decontaminate.segments([batch], 2 * n)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 * n  # as words, over 80 a word
    found = decontaminate.Segment(row.to_pylist()[0])
    assert sum(map(found.count, found.terms)) == n and found.lens.tolist() == [256] * (n // 256)
    at = found.phrase(tuple(w.encode() for w in words[256:266]))
    assert (257 in at) and found.doc_of(at[at == 257]).tolist() == [1]


def test_ends_are_compared_once(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    docs = spark.createDataFrame([(k, k, k, f"a{k} b{k} one two {passage} three four c{k}") for k in range(3)], "ord long, k1 long, k2 long, text string")
    found = linededup.removals(docs, linededup.LEAST, linededup.SEED)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2  # a side each; four in two chains before
    assert sorted(r.k1 for r in found.collect()) == [1, 2]


def test_chunks_cover_a_text_and_survive_shifts():
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [" ".join(words).encode(), ("new first words here\n" + "  ".join(words[7:])).encode(), ("new first words here " + " ".join(words[7:])).encode(), b"", b" \n ", b"one", "é\tü\r\nß 日本 x".encode()]
    c = linededup.Chunks(texts)
    for d, t in enumerate(texts):
        at = c.doc == d
        assert int(c.words[at].sum()) == len(plain.words(t.decode()))
        assert b" ".join(t[a:b] for a, b in zip(c.begin[at], c.end[at], strict=True)).split() == t.split()
        assert c.next[at].tolist() == c.begin[at][1:].tolist() + ([len(t)] if at.any() else [])
    a, b, e = (set(c.hash[c.doc == k].tolist()) for k in range(3))
    assert len(a) > 30 and len(a & e) >= len(a) - 4 and not a & b  # other white space makes other chunks
    assert linededup.Chunks([]).hash.tolist() == []
    assert int(np.median(c.words)) >= 6


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n日é", max_size=120))
def test_chunks_equal_a_plain_version(text):
    c, want = linededup.Chunks([text.encode()]), plain.chunks(text)
    assert [(int(h), int(a), int(b)) for h, a, b in zip(c.hash, c.first, c.last, strict=True)] == want


def test_chunks_of_a_text_beyond_the_table_of_powers():
    text = " ".join(f"word{i % 977}" for i in range(50_000)) + " " + "x" * 300_000
    c, part = linededup.Chunks([text.encode()]), linededup.Chunks([text[:100_000].encode()])
    assert len(text) > linededup.TABLE and c.hash[: len(part.hash) - 3].tolist() == part.hash[:-3].tolist()


def test_growth_stops_at_whole_words():
    assert linededup.shared_end(b"xab cd ", b"yab cd ") == (3, 1) and linededup.shared_end(b"ab cd ", b"ab cd ") == (6, 2) and linededup.shared_end(b"a", b"b") == (0, 0) and linededup.shared_end(b"x ab ", b"ab ") == (3, 1)
    assert linededup.shared_start(b" ab cdx", b" ab cdy") == (3, 1) and linededup.shared_start(b" ab", b" ab q") == (3, 1) and linededup.shared_start(b"", b"x") == (0, 0)
    assert linededup.shared_start("本語x".encode(), "本語y".encode()) == (6, 2) and linededup.shared_end("é ".encode(), "è ".encode()) == (0, 0)


def test_a_hash_with_two_texts_removes_nothing(spark, monkeypatch):
    def one(texts):
        c = linededup_chunks(texts)
        c.hash = np.minimum(c.hash, 5)  # all chunks have one hash
        return c

    linededup_chunks = linededup.Chunks
    docs = spark.createDataFrame([(k, k, k, " ".join(f"w{i % (20 + k)}" for i in range(60))) for k in range(4)], "ord long, k1 long, k2 long, text string").coalesce(1)
    assert linededup.removals(docs.withColumn("text", linededup.F.lit("a b c d e f g h " * 30)), 20, 10).count() == 4
    repeated = spark.createDataFrame([(5, 100, 0)], "hash long, n long, first long")
    monkeypatch.setattr(linededup, "repeated_hashes", lambda texts: repeated)
    found = linededup.candidates

    def collide(texts, bitmap, seed):
        rows = found(texts, np.full(1 << 16, 255, np.uint8), seed)
        return rows.withColumn("units", linededup.F.transform("units", lambda u: u.withField("hash", linededup.F.lit(5).cast("long"))))

    monkeypatch.setattr(linededup, "candidates", collide)
    assert linededup.removals(docs, 20, 10).collect() == []


def test_ids_that_are_no_integers(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(80))) for k in "abc"] + [(None, "x")], "doc_id string, text string")
    assert sorted(len(r.text.split()) for r in linededup.dedup_lines(docs).collect()) == [0, 0, 1, 80]


def test_water_level(spark):
    sizes = [(False, "a", 10), (False, "b", 1000), (False, "c", 500), (False, "d", 0), (True, "", 40)]
    got = {(r.s_null, r.s): r.target for r in mixing.targets(spark.createDataFrame(sizes, "s_null boolean, s string, source_size long")).collect()}
    weights = dict(zip([(n, s) for n, s, _ in sizes], (1, 2, 3, 1, 2), strict=True))
    left, free, want = 1550.0, set(weights), {}
    while free:
        share = {k: left * weights[k] / sum(weights[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * {(n, s): z for n, s, z in sizes}[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3 * {(n, s): z for n, s, z in sizes}[k]
            left -= want[k]
        free -= over
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1550)


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 200, 900]), rng.choice("aaaaabbc")) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("target").agg({"taken": "sum"}).collect()
    assert len(got) == 3 and all(abs(r["sum(taken)"] - r.target) <= 900 + 0.01 * r.target for r in got)


def test_the_filter_s_fill_changes_no_result(spark, monkeypatch):
    rng = random.Random(12)

    def some(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    passage = some(60)
    docs = spark.createDataFrame([(k, " ".join(some(70) + passage + some(70) + some(5) * 2)) for k in range(12)] + [(99, " ".join(some(50)))], "doc_id long, text string")
    want = sorted(tuple(r) for r in linededup.query(docs).collect())
    assert sum(r[1] for r in want) >= 11
    monkeypatch.setattr(linededup, "bloom_filter", lambda keys: np.full(1 << 16, 255, np.uint8))
    assert sorted(tuple(r) for r in linededup.query(docs).collect()) == want
    monkeypatch.setattr(linededup, "hot_keys", lambda counts, key, total: [r[0] for r in counts.select(key).limit(7).collect()])
    assert sorted(tuple(r) for r in linededup.query(docs).collect()) == want


def test_a_bloom_filter_holds_its_keys(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 62), 1 << 62, 20_000)
    bitmap = common.bloom_filter(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert common.passes(bitmap, keys).all()
    assert common.passes(bitmap, rng.integers(-(1 << 62), 1 << 62, 20_000)).mean() < 0.02
    assert not common.passes(common.bloom_filter(spark.createDataFrame([], "k long")), keys).any()
