"""Plain versions of operators, written from their docstrings: loops, dictionaries and whole numbers, and nothing of the package."""

import collections
import re

M = (1 << 64) - 1
B_BYTE, B_WORD, B_LINE, B_GAP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
FOLD, MOST, SEED, LEAST, NEAR = 5, 8, 10, 20, 16
WORDS = re.compile(r"[　-\udfff]|[^\x20\x09-\x0D　-\udfff]+")

INNER = re.compile(r"[^\x20\x09-\x0D\u3000-\udfff]")


def mix(x):
    x = ((x ^ (x >> 32)) * B_WORD) & M
    return x ^ (x >> 29)


def words(text):
    """(start, stop) in bytes."""
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode()))
    return [(at[m.start()], at[m.end()]) for m in WORDS.finditer(text)]


def chunks(text):
    """(hash, first word, last word) of each chunk of a text."""
    raw, spans = text.encode(), words(text)
    n = len(spans)
    if not n:
        return []
    h = []
    for s, e in spans:
        total, power = 0, 1
        for b in raw[s:e]:
            total, power = (total + b * power) & M, power * B_BYTE & M
        h.append(mix(total))
    two = [mix((h[i] * 3 + h[i + 1]) & M) for i in range(n - 1)] + [h[-1]]
    ends = {i for i in range(n) if i == n - 1 or b"\n" in raw[spans[i][1] : spans[i + 1][0]]}
    for i in range(n - FOLD + 1):
        low = min(two[i : i + FOLD])
        ends |= {j for j in range(i, i + FOLD) if two[j] == low}
    lines, start = [], 0
    for e in sorted(ends):
        total = 0
        for k, i in enumerate(range(start, e + 1)):
            gap = (spans[i + 1][0] - spans[i][1]) * B_GAP if i < e else 0
            total += (h[i] + gap) * pow(B_WORD, k, 1 << 64)
        lines.append((start, e, mix((total + e - start + 1) & M)))
        start = e + 1
    rolled = [M] + [mix((a[2] * B_LINE + b[2]) & M) for a, b in zip(lines, lines[1:], strict=False)] + [M]
    out, held = [], []
    for i, line in enumerate(lines):
        held.append(line)
        if i == len(lines) - 1 or len(held) == MOST and not 0 < i < len(lines) - 1 or 0 < i < len(lines) - 1 and rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1] or len(held) == MOST:
            total = 0
            for k, (_, e, x) in enumerate(held):
                gap = (spans[e + 1][0] - spans[e][1]) * B_GAP if k < len(held) - 1 else 0
                total += (x + gap) * pow(B_LINE, k, 1 << 64)
            out.append((mix((total + held[-1][1] - held[0][0] + 1) & M), held[0][0], held[-1][1]))
            held = []
    return out


def equal_words(raw, spans, i, other, other_spans, j, step, most, other_most):
    """Words from i (and j) on in steps that are equal, with the white space before each (that between a run and its neighbour included)."""
    n = 0
    while n < most and n < other_most:
        a, b = i + step * n, j + step * n
        if step > 0:
            x, y = raw[spans[a - 1][1] : spans[a][1]], other[other_spans[b - 1][1] : other_spans[b][1]]
        else:
            x, y = raw[spans[a][0] : spans[a + 1][0]], other[other_spans[b][0] : other_spans[b + 1][0]]
        if x != y:
            break
        n += 1
    return n


def dedup(docs):
    """docs: (doc_id, text). The byte ranges that go of each distinct document."""
    rows = sorted({(d is None, d or 0, t) for d, t in docs if t})
    times = collections.Counter((d is None, d or 0, t) for d, t in docs)
    raws, spans, found = [r[2].encode() for r in rows], [words(r[2]) for r in rows], [chunks(r[2]) for r in rows]
    count, first = collections.Counter(), {}
    for r, c in enumerate(found):
        for h, _, _ in c:
            count[h] += times[rows[r]]
            first.setdefault(h, rows[r][:2])
    runs = []  # document, first chunk, last chunk
    for r, c in enumerate(found):
        i = 0
        while i < len(c):
            j = i
            while j < len(c) and count[c[j][0]] > 1:
                j += 1
            if j > i and c[j - 1][2] - c[i][1] + 1 >= SEED:
                runs.append((r, i, j - 1))
            i = max(j, i + 1)
    edges = {}
    for r, i, j in runs:
        if spans[r][found[r][i][1]][0] > 0:
            edges.setdefault((-1, found[r][i][0]), (r, i))
        if spans[r][found[r][j][2]][1] < len(raws[r]):
            edges.setdefault((1, found[r][j][0]), (r, j))
    reach = lambda r, k, step: min(len(spans[r]) - 1 - found[r][k][2], (found[r][k + 1][2] - found[r][k + 1][1] + 1 if k + 1 < len(found[r]) else 0) + NEAR) if step > 0 else min(found[r][k][1], (found[r][k - 1][2] - found[r][k - 1][1] + 1 if k else 0) + NEAR)
    out = {row: [] for row in rows}
    for r, i, j in runs:
        grow = {}
        for step, k in ((-1, i), (1, j)):
            o, m = edges.get((step, found[r][k][0]), (r, k))
            if rows[o][:2] < rows[r][:2]:
                a, b = (found[r][k][1] - 1, found[o][m][1] - 1) if step < 0 else (found[r][k][2] + 1, found[o][m][2] + 1)
                grow[step] = equal_words(raws[r], spans[r], a, raws[o], spans[o], b, step, reach(r, k, step), reach(o, m, step))
        seen = {h for h, _, _ in found[r][:i]}
        gone, held = [], []
        for k in range(i, j + 1):
            h = found[r][k][0]
            if first[h] < rows[r][:2] or h in seen:
                held.append(k)
            seen.add(h)
        for k in held:
            if gone and gone[-1][-1] == k - 1:
                gone[-1].append(k)
            else:
                gone.append([k])
        for g in gone:
            a, z = found[r][g[0]][1], found[r][g[-1]][2]
            left, right = grow.get(-1, 0) if g[0] == i else 0, grow.get(1, 0) if g[-1] == j else 0
            if z - a + 1 >= SEED and z - a + 1 + left + right >= LEAST:
                after = spans[r][z + right][1] if right else spans[r][z + 1][0] if z + 1 < len(spans[r]) and g[-1] + 1 < len(found[r]) else len(raws[r])
                out[rows[r]].append((spans[r][a - left][0], after))
    merged = {}
    for row, ranges in out.items():
        merged[row] = []
        for s, e in sorted(ranges):
            if merged[row] and s <= merged[row][-1][1]:
                merged[row][-1] = (merged[row][-1][0], max(e, merged[row][-1][1]))
            else:
                merged[row].append((s, e))
    return merged


def cut(text, ranges):
    raw, at, out = text.encode(), 0, b""
    for s, e in [*ranges, (len(raw), len(raw))]:
        part = raw[at:s]
        if INNER.match(out.decode()[-1:]) and INNER.match(part.decode()[:1]):
            out += b" "  # words that only what went had kept apart
        out, at = out + part, e
    return out.decode()


def class_logs(p, hop, classes, rows, kinds, i):
    """log P of each class at position i of a text: one attention head over the positions from hop before i's block on. p: parameters."""
    import math

    d = len(p["q"])
    block = i // hop * hop

    def embedded(at):
        return p["e"][rows[at - 1]] if at else p["e"][len(p["e"]) - 1]

    q = embedded(i) @ p["q"] / math.sqrt(d)
    seen = list(range(max(0, block - hop), i + 1))
    scores = [min(float(q @ (embedded(j) @ p["k"])), 50.0) + min(float(p["rel"][i - j]), 20.0) for j in seen]
    top = max(scores)
    weights = [math.exp(s - top) for s in scores]
    mixed = sum(w / sum(weights) * (embedded(j) @ p["v"]) for w, j in zip(weights, seen, strict=True))
    logits = mixed @ p["o"] + p["skip"][kinds[i - 1] if i else classes]
    top = max(logits.tolist())
    total = sum(math.exp(x - top) for x in logits.tolist())
    return [x - top - math.log(total) for x in logits.tolist()]


def spelt(p, hop, classes, row_of, class_of, log_piece, begins, words):
    """log P of each word (a list of subwords; the last is the end) of a text given those before it."""
    import math

    flat = [z for w in words for z in w]
    rows, kinds = [int(row_of[z]) for z in flat], [int(class_of[z]) for z in flat]
    first_kinds = {int(class_of[z]) for z in range(len(class_of)) if begins[z]}
    own, opening = [], []
    for i, z in enumerate(flat):
        logs = class_logs(p, hop, classes, rows, kinds, i)
        own.append(logs[kinds[i]] + float(log_piece[z]))
        opening.append(math.log(sum(math.exp(logs[k]) for k in first_kinds)))
    out, at = [], 0
    for k, w in enumerate(words):
        after = opening[at + len(w)] if k + 1 < len(words) else 0.0
        out.append(sum(own[at : at + len(w)]) - opening[at] + after)
        at += len(w)
    return out


def add_logs(a, b):
    import math

    low, high = min(a, b), max(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def spans_of(word, prob, unknown):
    """(from, to, piece) of all pieces in a word, by where they begin; a character that is none is unknown."""
    n = len(word)
    return [(i, j, word[i:j] if word[i:j] in prob else unknown) for i in range(n) for j in range(i + 1, min(n, i + 40) + 1) if word[i:j] in prob or j == i + 1]


def ahead_of(word, spans, logs):
    out = [0.0] + [-float("inf")] * len(word)
    for i, j, p in spans:
        out[j] = add_logs(out[j], out[i] + logs[p])
    return out


def segmentations(word, logs, unknown):
    """log of a word's probability, the sum over all its segmentations. logs: piece to log of its probability."""
    return ahead_of(word, spans_of(word, logs, unknown), logs)[-1]


def expected(word, logs, unknown):
    """Each piece's expected count in a word."""
    import math

    spans = spans_of(word, logs, unknown)
    ahead, back = ahead_of(word, spans, logs), [-math.inf] * len(word) + [0.0]
    for i, j, p in reversed(spans):
        back[i] = add_logs(back[i], logs[p] + back[j])
    out = collections.Counter()
    for i, j, p in spans:
        out[p] += math.exp(ahead[i] + logs[p] + back[j] - ahead[-1])
    return out


def letters_of(text):
    return ["▁" + w for w in re.split(r"[\x00-\x60\x7b-\x7f]+", text.lower()) if w]


def languages(docs, pieces, held, iterations=2, smooth=0.05, temper=12.0):
    """docs: (doc_id, text, lang). (lang_pred, score) of each, learned from those not held out."""
    import math

    unknown = None
    counts = {}
    for d, t, lang in docs:
        if t is not None and lang is not None and not held(d):
            counts.setdefault(lang, collections.Counter()).update(letters_of(t))
    names = sorted(k for k in counts if counts[k])
    logs = {k: dict.fromkeys([*pieces, unknown], -math.log(len(pieces) + 1)) for k in names}
    for _ in range(iterations):
        for k in names:
            total = collections.Counter()
            for w, n in counts[k].items():
                for p, x in expected(w, logs[k], unknown).items():
                    total[p] += n * x
            mass = sum(total.values()) + smooth * (len(pieces) + 1)
            logs[k] = {p: math.log((total[p] + smooth) / mass) for p in logs[k]}
    out = []
    for _, t, _ in docs:
        if not t or not any(c.isalpha() for c in t) or not names:
            out.append(("und", 0.0))
            continue
        words = letters_of(t)
        sums = [sum(n * segmentations(w, logs[k], unknown) for w, n in collections.Counter(words).items()) for k in names]
        best = max(range(len(names)), key=lambda i: (sums[i], -i))
        out.append((names[best], 1 / sum(math.exp((x - sums[best]) * min(1, temper / len(words))) for x in sums)))
    return out


def shingles(text, width):
    """The set of shingles of so many words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
