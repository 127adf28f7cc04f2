import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = "Lorem " * 30_000
PASSAGE = " ".join(f"word{i}" for i in range(60))
PROSE = {
    "en": "the river was wide and the boats went down it in the morning when the sun came up over the hills",
    "de": "der fluss war breit und die boote fuhren am morgen hinunter als die sonne über den bergen aufging",
    "fr": "la rivière était large et les bateaux descendaient le matin quand le soleil se levait sur les collines",
}


def documents():
    rows, i = [], 0
    for lang, text in PROSE.items():
        words = text.split()
        for k in range(14):
            body = "\n".join(" ".join(words[(k + j) % len(words) :] + words[: (j * 3 + k) % 7]) + f" {lang}{k}x{j}." for j in range(4))
            rows.append((i, body, lang, f"s{i % 5}", len(body)))
            i += 1
    a, b = rows[0][1], rows[20][1]
    for text, lang, source in (
        (None, "en", "s1"), ("", "de", None), ("   \n\t ", None, "s2"), (LONG, "en", "s0"), (a, "en", "s3"), (a, "en", "s3"), (a + " extra", "en", "s4"), (b.upper(), "de", "s0"),
        (PASSAGE + "\nown line one here\n", "en", "s1"), ("another start\n" + PASSAGE, "en", "s2"), (PASSAGE, "en", "s2"),
        ("mail bob@x.example.org or b.c@d.e@f.g, ip 10.0.0.255 256.1.1.1 1.2.3.4.5, card 4111 1111 1111 1111 x 4111111111111112, tel +1 (743) 555-3824 +12", "en", "s1"),
        ("IBAN DE89 3704 0044 0532 0130 00 bank; ssn 123-45-6789; é@ü.com a@b.co.uk.", None, "s1"), ("!!! ??? 123 --- …", "en", "s9"), ("x", "en", "s9"), ("1" * 5000, "en", "s9"), ("0" * 5000 + ".0.0.1 and token = \"f0ddae3b09ae356cbefecdd3232fa5489bb400d6\" IBAN GB82 WEST 1234 5698 7654 32 END", "en", "s9"),
        ("х" * 90 + " " + "漢字かな" * 30 + " straße", "de", "s9"),
    ):
        rows.append((i, text, lang, source, None if text is None else len(text)))
        i += 1
    rows.append(rows[5])  # a repeated row
    rows.append((None, "a document without an id", "en", "s1", 24))
    return rows


ITEMS = [(0, " ".join(PROSE["en"].split()[2:14])), (1, "short item text"), (2, None), (3, ""), (3, PASSAGE[:200]), (4, "…!?"), (10, " ".join(PROSE["en"].split()[4:14]).upper())]


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    """A folder of small tables with awkward rows, and columns whose names clash with those that operators make."""
    d = tmp_path_factory.mktemp("edge")
    rows = documents()
    cols = list(zip(*rows, strict=True))
    extra = {"score": pa.array([0.5] * len(rows)), "size": pa.array(["big"] * len(rows)), "fp": pa.array([None] * len(rows), pa.string()), "segment": pa.array([1] * len(rows)), "key": pa.array(["k"] * len(rows)), "rank": pa.array([9] * len(rows)), "at": pa.array([1] * len(rows)), **{n: pa.array([f"{n}!"] * len(rows)) for n in ("row", "k1", "k2", "gone", "may", "ord", "salt", "first", "root", "least", "n", "copies", "s", "h", "a.b", "__0", "__text", "mix_n", "digit", "bin", "hash", "lang_pred", "spans")}, "held_out": pa.array(["?"] * len(rows))}
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "text", "lang", "source", "n_chars"), cols, types, strict=True)} | extra), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in ITEMS], pa.int64()), "text": pa.array([t for _, t in ITEMS], pa.string()), "segment": pa.array([0] * len(ITEMS))}), d / "benchmark.parquet")
    pages = [(0, "http://a/1", "<p>ä</p>"), (1, "http://a/2", "<p>ä</p>"), (2, None, None), (3, "http://b/ x\ny", ""), (4, "http://b", "x" * 400_000), (0, "http://a/1", "<p>ä</p>"), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>ä</p>")]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages], "html": pa.array([p[2] for p in pages], pa.string()), "first": pa.array([1] * len(pages)), "sha": pa.array(["x"] * len(pages))}), d / "pages.parquet")
    rng = random.Random(8)
    vectors = [(i, [round(rng.gauss(0.5, 1), 2) for _ in range(4)], rng.randrange(3)) for i in range(160)] + [(200 + i, [1.0] * 4, i % 2) for i in range(60)]
    vectors += [(None, [1.0] * 4, 1), (250, None, 1), (251, [1.0, None, 0.0, 0.0], 1), (252, [float("nan")] * 4, 1), (253, [float("inf")] * 4, 1), (254, [1.0] * 4, None), (255, [1.0] * 3, 1), (256, [], 1), (300, [0.0] * 4, 2), vectors[3]]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "label": pa.array([v[2] for v in vectors], pa.int32()), "score": ["x"] * len(vectors), "id": [1] * len(vectors)}), d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(edge, tmp_path_factory):
    """The same tables without rows."""
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "pages"):
        pq.write_table(pq.read_table(f"{edge}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    pq.write_table(pq.read_table(f"{edge}/embeddings.parquet").slice(0, 0), d / "embeddings.parquet")
    return str(d)
