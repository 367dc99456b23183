"""Plain versions of the operators, to hold them against."""

import hashlib
import math
import re
import zlib

import numpy as np

WS = "\x20\x09-\x0d"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(f"[^{WS}]+", text or "")


def shingles(text, size=3):
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(docs, size=3, percent=85):
    """docs: [(id, text)] with ids once -> {id: (n, component)}."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def exact(docs):
    """docs: [(id, text)] -> rows (id, keep, size, kept, sha)."""
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(f"[{WS}]", "", t or ""), []).append((-len(t or ""), i))
    return [(i, min(g)[1], len(g), i == min(g)[1], sha(body)) for body, g in groups.items() for _, i in g]


def rules(text):
    text = text or ""
    w = words(text)
    spans = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, s in enumerate(spans) if spans.count(s) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def secrets(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(SECRETS):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(x for _, _, x in sorted(found))


# Fixed values of the battery: alphabets from narrow to wide, models of text by class of characters.
DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [DIGIT, DIGIT + "abcdef", DIGIT + "ABCDEF", UPPER + "234567", DIGIT + LOWER, DIGIT + UPPER, UPPER + LOWER + DIGIT]
ALPHABETS += [UPPER + LOWER + DIGIT + "+/", UPPER + LOWER + DIGIT + "-_", UPPER + LOWER + DIGIT + "+/-_"]
SHARES = [(0.80, 0.06, 0.10, 0.04), (0.06, 0.80, 0.10, 0.04), (0.06, 0.06, 0.84, 0.04)]


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def battery(body):
    """(n, p, log e) of a run, by the textbook's sums."""
    alphabet = next(a for a in ALPHABETS if set(body) <= set(a))
    n, k = len(body), len(alphabet)
    x = np.array([alphabet.index(c) for c in body], float)
    chi = sum((body.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    z = ((max(chi / (k - 1), 1e-9)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    p = [tail(z) if z > 0 else 1.0]
    high = x >= k / 2
    a, b = high.sum(), n - high.sum()
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p.append(2 * tail(abs(1 + (high[1:] != high[:-1]).sum() - mean) / math.sqrt(var)) if var > 0 else 0.0)
    d = x - x.mean()
    p.append(2 * tail(abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n)) if d.any() else 0.0)
    sizes = [sum(c in group for c in body) for group in (LOWER, UPPER, DIGIT, "+/_-")]
    text = max(sum(c * math.log(s / w) for c, s, w in zip(sizes, shares, (26, 26, 10, 4), strict=True)) for shares in SHARES)
    return n, min(1.0, 3 * min(p)), -n * math.log(k) - text


def random_spans(texts, fdr=0.01, step=0.25, most=400.0):
    """[(text, start, end)] of the runs that the battery finds random, by sorting all values of an octave."""
    octaves = {}
    for i, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?", t or ""):
            spans = [m.span()]
            if set("+/") & set(m[0]) and set("_-") & set(m[0]):
                spans += [(m.start() + q.start(), m.start() + q.end()) for p in ("[A-Za-z0-9+/]{20,}=*", "[A-Za-z0-9_-]{20,}=*") for q in re.finditer(p, m[0])]
            for a, b in spans:
                n, p, e = battery(t[a:b].rstrip("="))
                octaves.setdefault(int(math.log2(n)), []).append((p, e, i, a, b))
    down = lambda x: math.floor(min(x, most) / step) * step
    out = []
    for runs in octaves.values():
        m = len(runs)
        harmonic = m * sum(1 / i for i in range(1, m + 1))
        logs = sorted((down(-math.log(p)) if p > 0 else most for p, *_ in runs), reverse=True)
        ranks = [k for k in range(m) if harmonic * math.exp(-logs[k]) <= fdr * (k + 1)]
        least = logs[max(ranks)] if ranks else math.inf
        left = [(0 if e <= 0 else down(e), *where) for p, e, *where in runs if (-math.log(p) if p > 0 else most) < least]
        left = sorted((r for r in left if r[0] > 0), reverse=True)
        good = [k for k in range(len(left)) if m * math.exp(-left[k][0]) <= fdr * (k + 1)]
        limit = left[max(good)][0] if good else math.inf
        out += [tuple(where) for e, *where in left if e >= limit]
    return sorted(out)


PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def licenses(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_matches(text, rules, prefixes):
    """rules: [(priority, confidence, label, pattern)] -> [(start, stop, priority, label, confidence)] that lie within no match of equal or higher priority."""
    line = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))) + " "
    found = []
    for k, (prio, conf, label, pattern) in enumerate(rules):
        for m in pattern.finditer(line):
            grade = next(((p, c) for p, c, expr in prefixes if re.fullmatch(expr, m[1])), (prio, conf)) if m[1] else (prio, conf)
            found.append((m.start(), -m.end(), grade[0], k, label, grade[1]))
    found.sort()
    out = []
    for i, (a, b, p, _, label, c) in enumerate(found):
        within = (x for j, x in enumerate(found) if j != i and x[0] <= a and x[1] <= b and x[2] <= p)
        if not any(x[:3] != (a, b, p) or x < found[i] for x in within):
            out.append((a, -b, p, label, c))
    return sorted(out)


def crc32(ident):
    return zlib.crc32(str(ident).encode())


MARKS = [".", ",", "|", "!", "?", "\n", '"', "#*$%&<>@^~", "0123456789", UPPER, "-_/=+:;()[]{}"]


def text_statistics(text):
    """The statistics of a text, one after the other."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n or not (text or "").strip():
        return [0.0] * 21
    out = [math.log1p(sum((text or "").count(c) for c in m)) - math.log1p(n) for m in MARKS]
    lines = [x for x in data.split(b"\n") if x.strip()]
    mean = sum(map(len, words)) / n
    shares = [data.count(b) / len(data) for b in set(data)]
    out += [math.log1p(n), mean, math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n), math.log(len(set(words)) / n)]
    out += [math.log1p(len({(words[i], words[i + 1]) for i in range(n - 1)})) - math.log(n), max(words.count(w) for w in set(words)) / n]
    out += [len(set(lines)) / max(1, len(lines)), math.log(n / max(1, len(lines))), -sum(p * math.log(p) for p in shares), sum(b > 127 for b in data) / len(data)]
    return out


def quality(docs, labels, features=384, gamma=0.04, ridge=1e-2, seed=11, bins=2000):
    """{id: score} by one matrix of all labelled rows: least squares with the ridge as rows of its own, and the max-min formula of isotonic regression."""
    x = {i: np.array(text_statistics(t), np.float32).astype(float) for i, t in docs}
    known = [(i, y) for i, y in labels if y is not None and i in x and crc32(i) % 5]
    fit = [(i, y) for i, y in known if crc32(i) % 5 != 1]
    rows, y = np.array([x[i] for i, _ in fit]), np.array([y for _, y in fit], float)
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    freq = rng.normal(0, math.sqrt(2 * gamma), (rows.shape[1], features))
    phase = rng.uniform(0, 2 * math.pi, features)

    def lifted(r):
        return np.append(math.sqrt(2 / features) * np.cos(np.clip((r - mean) / scale, -6, 6) @ freq + phase), 1.0)

    extra = np.sqrt(np.append(np.full(features, ridge * len(y) / 1000 + 1e-9), 1e-9))
    weight = np.linalg.lstsq(np.vstack([[lifted(r) for r in rows], np.diag(extra)]), np.concatenate([y, np.zeros(features + 1)]), rcond=None)[0]
    raw = {i: min(1.5, max(-0.5, float(lifted(r) @ weight))) for i, r in x.items()}
    cells = {}
    for i, label in known:
        if crc32(i) % 5 == 1:
            cells.setdefault(min(int((raw[i] + 0.5) / 2 * bins), bins - 1), []).append(label)
    at = sorted(cells)
    part = lambda a, b: np.mean([v for k in at[a : b + 1] for v in cells[k]])
    steps = [max(min(part(a, b) for b in range(j, len(at))) for a in range(j + 1)) for j in range(len(at))]
    return {i: float(np.clip(np.interp(r, [(k + 0.5) / bins * 2 - 0.5 for k in at], steps), 0, 1)) for i, r in raw.items()}


def spark_hash(text, number):
    """Spark's 64-bit xxHash of a text and an integer, as a signed integer."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    h = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def languages(rows, docs=128, piece=1024, cuts=8, block=4096, level=3):
    """rows: [(id, text, lang)] -> {id: (lang, score)} by a plain loop over zstandard dictionaries."""
    import zstandard

    bare = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).encode()
    train = [(t, lang) for i, t, lang in rows if i is not None and crc32(i) % 3 != 1 and t and lang is not None]
    names = sorted({lang for _, lang in train})
    coders, prior = [], []
    for name in names:
        size, said = piece // cuts - 1, []
        for t in sorted({t for t, lang in train if lang == name}, key=lambda t: spark_hash(t, 7))[:docs]:
            first = (spark_hash(t, 11) % 1000) / 1000.0
            places = [int((first + k) * (len(t) - size) / cuts) for k in range(cuts)]
            said.append(t if len(t) <= piece else " ".join(t[p : p + size] for p in places))
        coders.append(zstandard.ZstdCompressionDict(bare(" ".join(said)), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        prior.append(-math.log2(sum(lang == name for _, lang in train) / len(train)) / 8)
    out = {}
    for i, t, _ in rows:
        if not t or not names or not re.search(r"[^\W\d_]", t):
            out[i] = ("und", 0.0)
            continue
        data, sizes = bare(t), []
        for words, p in zip(coders, prior, strict=True):
            words.precompute_compress(level=level)
            coder = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(p + sum(len(coder.compress(data[k : k + block])) for k in range(0, len(data), block)))
        best = min(sizes)
        unit = max(1.0, 0.005 * best)
        out[i] = (names[sizes.index(best)], 1 / sum(math.exp((best - s) / unit) for s in sizes))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
