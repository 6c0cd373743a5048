"""One pair at a time in plain Python: all 17 distances, the self distance, the score and the report. Shares no code with the library."""

import math
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache
from statistics import mean, stdev

import regex

CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
TOKEN = regex.compile(rf"(?V1)[\p{{L}}&&[{CJK}]]|[[\p{{L}}\p{{Nd}}\p{{M}}]--[{CJK}]]+")
LETTER = regex.compile(r"\p{L}")
MARKS = ",.!?;:«»\"'()—–…-"
WEIGHTS = [0.18, 0.12, 0.12, 0.08, 0.04, 0.10, 0.06, 0.12, 0.08, 0.04, 0.06, 0.04, 0.10, 0.04, 0.04, 0.10, 0.10]


@lru_cache(None)
class Text:
    def __init__(self, raw):
        text = unicodedata.normalize("NFC", raw).replace("\r\n", "\n").replace("\r", "\n").strip("".join(map(chr, range(33))))
        self.text = text
        self.words = TOKEN.findall(text.lower())
        self.letters = "".join(c.lower() for c in text if LETTER.match(c))
        self.n_letters = len(LETTER.findall(text))
        self.sentences = [n for n in (len(TOKEN.findall(s)) for s in regex.split(r"[\n.!?…。！？؛۔॥|]", text.lower())) if n]
        self.paragraphs = [n for n in (len(TOKEN.findall(s)) for s in text.lower().split("\n")) if n]
        self.counts = Counter(self.words)
        self.shares = rel(self.counts)

    @lru_cache(None)
    def grams(self, n):
        return rel(Counter(self.letters[i : i + n] for i in range(len(self.letters) - n + 1)))

    def per_1000(self, n):
        return n / (max(1, self.n_letters) / 1000)

    def punct(self):
        return [self.per_1000(self.text.count(m)) for m in MARKS]

    def typo(self):
        t = self.text
        count = lambda p: len(regex.findall(p, t, overlapped=True))
        caps = sum(1 for m in regex.finditer(r"\p{L}+", t) if m.end() < len(t) and regex.fullmatch(r"\p{Lu}{3,}", m[0]))
        emoji = sum(ord(c) >= 0x1F000 or 0x2600 <= ord(c) <= 0x27BF or 0x2190 <= ord(c) <= 0x21FF for c in t)
        found = [
            sum(c in ",.!?;:" and (i == 0 or t[i - 1] in " \t\n") for i, c in enumerate(t)), count("  "), len(regex.findall(r"\.{3,}", t)), t.count("…"), t.count("—"), t.count("- "),
            t.count("–"), t.count('"'), sum(c in "«»" for c in t), sum(c in "“”„" for c in t), count(r"\p{L}'\p{L}"), emoji + 3 * caps,
        ]
        return [self.per_1000(n) for n in found]

    def richness(self):
        n, c = len(self.words), self.counts
        if not n:
            return 0, 0, 0, 0
        return len(c) / math.sqrt(n), sum(v == 1 for v in c.values()) / len(c), 1e4 * (sum(v * v for v in c.values()) - n) / n**2, -sum(p * math.log(p) for p in self.shares.values())

    def zipf(self):
        late = sorted(self.counts.values(), reverse=True)[9:1000]
        if len(late) < 2:
            return 0
        x, y = [math.log(r) for r in range(10, 10 + len(late))], [math.log(v) for v in late]
        return sum((a - mean(x)) * (b - mean(y)) for a, b in zip(x, y, strict=True)) / sum((a - mean(x)) ** 2 for a in x)

    def chunks(self):
        n, size, t = len(self.words), len(self.text), self.text
        k = 4 if n >= 1400 else 3 if n >= 700 else 2 if n >= 260 else 0
        weight = {"\n": 0.5, **dict.fromkeys(".!?…。", 0.75), " ": 1.0, "\t": 1.0}
        cuts = [0]
        for i in range(1, k):
            target, span = math.floor(size * i / k + 0.5), max(1, size // 8)
            fit = [(weight[t[p - 1]] * abs(p - target), p) for p in range(max(cuts[-1] + 1, target - span), min(size - 1, target + span) + 1) if t[p - 1] in weight]
            cut = min(fit)[1] if fit else target
            cuts.append(max(cuts[-1] + 1, min(target, size - 1)) if cut <= cuts[-1] or cut >= size else cut)
        return [t[a:b] for a, b in zip(cuts, [*cuts[1:], size], strict=True)] if k else []


def rel(counts):
    total = sum(counts.values())
    return {g: c / total for g, c in counts.items()}


def top(p, q, n):
    return sorted(p.keys() | q.keys(), key=lambda g: (-(p.get(g, 0) / 2 + q.get(g, 0) / 2), g))[:n]


def cosine(p, q, keys, both_zero=0.0):
    aa, bb = sum(p.get(k, 0) ** 2 for k in keys), sum(q.get(k, 0) ** 2 for k in keys)
    if not aa or not bb:
        return both_zero if aa == bb else 0.0
    return sum(p.get(k, 0) * q.get(k, 0) for k in keys) / (math.sqrt(aa) * math.sqrt(bb))


def jsd(p, q):
    if not sum(p.values()) or not sum(q.values()):
        return 0.0 if sum(p.values()) == sum(q.values()) else 0.5
    kl = lambda a, b: sum(v * math.log(v / ((v + b.get(k, 0)) / 2)) for k, v in a.items() if v > 0)
    return min(1.0, (0.5 * kl(p, q) + 0.5 * kl(q, p)) / math.log(2))


def kept(p, keys):
    total = sum(p.get(k, 0) for k in keys)
    return {k: p.get(k, 0) / total for k in keys} if total > 0 else dict.fromkeys(keys, 0)


def hist(values, bins):
    held = Counter(min(bins, max(1, v)) for v in values)
    return [held[b] / len(values) if values else 0 for b in range(1, bins + 1)]


def listed(v):
    return dict(enumerate(v))


def ks(p, q):
    return max(abs(sum(p[: i + 1]) - sum(q[: i + 1])) for i in range(len(p)))


def delta(a, b):
    sides = [[rel(Counter(Text(c).words)) for c in t.chunks()] for t in (a, b)]
    if min(map(len, sides)) < 2:
        return None
    every = sides[0] + sides[1]
    average = {g: (sum(sorted(c.get(g, 0) for c in sides[0])) + sum(sorted(c.get(g, 0) for c in sides[1]))) / len(every) for g in {g for c in every for g in c}}
    centres = [{}, {}]
    for g in sorted(average, key=lambda g: (-average[g], g))[:150]:
        values = [c.get(g, 0) for c in every]
        sd = stdev(values)
        z = [max(-2, min(2, (v - average[g]) / sd)) if sd > 0 else 0 for v in values]
        for side, own in enumerate((z[: len(sides[0])], z[len(sides[0]) :])):
            centres[side][g] = 0 if abs(sum(own) / len(own)) < 1e-12 else sum(own) / len(own)
    return 1 - cosine(*centres, centres[0], both_zero=1.0)


def robustness(a, b):
    def mixed(p, q, u, v):
        return 0.5 * (1 - cosine(p, q, p.keys() | q.keys())) + 0.5 * jsd(u, v)

    def without(p, q, most):
        drop = min(most, max(1, (len(p) + len(q)) // 6))
        gone = set(sorted(p.keys() | q.keys(), key=lambda g: (-abs(p.get(g, 0) - q.get(g, 0)), g))[:drop])
        left = (p.keys() | q.keys()) - gone
        return kept(p, left), kept(q, left)

    p, q = a.grams(3), b.grams(3)
    before = mixed(p, q, a.shares, b.shares)
    if before < 0.02:
        return 0.0
    if min(len(a.words), len(b.words)) < 800:
        return None
    return mixed(*without(p, q, 150), *without(a.shares, b.shares, 120)) / before


def compression(a, b):
    if min(len(a.words), len(b.words)) < 200:
        return None
    x, y = ("".join(w + " " for w in t.words[:4000]).encode() for t in (a, b))

    def size(data, preset=None):
        packer = zlib.compressobj(9, zdict=preset) if preset else zlib.compressobj(9)
        return len(packer.compress(data) + packer.flush())

    return (0.5 * (size(x, y) / size(x) + size(y, x) / size(y)) - 0.82) / 0.18


@lru_cache(None)
def distances(a, b):
    p, q, u, v = a.grams(3), b.grams(3), a.shares, b.shares
    c2, d2 = a.grams(2), b.grams(2)
    words = top(u, v, 100)
    m3 = [abs(u.get(w, 0) * 1000 - v.get(w, 0) * 1000) / (u.get(w, 0) * 1000 + v.get(w, 0) * 1000 + 0.5) for w in words]
    m4 = top(u, v, 300)
    r, s = a.richness(), b.richness()
    logs = []
    for x, y in zip(r[2:], s[2:], strict=True):
        lx, ly = math.log(max(x, 1e-9)), math.log(max(y, 1e-9))
        logs.append(0 if lx + ly == 0 and x + y > 0 else abs(lx - ly) / max(1e-9, lx + ly))
    plain = [abs(x - y) / (x + y) if x + y > 0 else 0 for x, y in zip(r[:2], s[:2], strict=True)]
    common, own = top(u, v, 50), [set(top(x, {}, 50)) for x in (u, v)]
    union = [w for w in common if w in own[0] | own[1]]
    most = top(p, q, 400)
    larger = sum(max(p.get(g, 0), q.get(g, 0)) for g in most)
    smooth = lambda t: {i: (x + 0.5) / (sum(t.punct()) + 8) for i, x in enumerate(t.punct())}
    found = [
        1 - cosine(p, q, top(p, q, 300)), 1 - cosine(c2, d2, top(c2, d2, 250)), mean(m3) if m3 else 0, jsd(kept(u, m4), kept(v, m4)), jsd(a.grams(1), b.grams(1)),
        ks(hist(a.sentences, 40), hist(b.sentences, 40)), jsd(listed(hist([len(w.encode("utf-16-le")) // 2 for w in a.words], 15)), listed(hist([len(w.encode("utf-16-le")) // 2 for w in b.words], 15))),
        jsd(smooth(a), smooth(b)), mean(plain + logs), 1 - len([w for w in union if w in own[0] & own[1]]) / len(union) if union else 0,
        1 - cosine(listed(a.typo()), listed(b.typo()), range(12), both_zero=1.0), delta(a, b), robustness(a, b),
        abs(a.zipf() - b.zipf()) / 0.30 if min(len(a.counts), len(b.counts)) >= 30 else None,
        ks(hist(a.paragraphs, 60), hist(b.paragraphs, 60)) if min(len(a.paragraphs), len(b.paragraphs)) >= 4 else None, compression(a, b),
        1 - (sum(min(p.get(g, 0), q.get(g, 0)) for g in most) / larger if larger else 0) if p and q else None,
    ]
    return [None if d is None else min(1.0, max(0.0, d)) for d in found]


def weighted(found):
    held = [(d, w) for d, w in zip(found, WEIGHTS, strict=True) if d is not None]
    return sum(d * w for d, w in held) / sum(w for _, w in held) if held else 0.0


@lru_cache(None)
def own_distance(t):
    chunks = [Text(c) for c in t.chunks()]
    if len(chunks) < 2 or min(len(c.words) for c in chunks) < 100:
        return None
    return mean(weighted(distances(chunks[i], chunks[j])) for i in range(len(chunks)) for j in range(i + 1, len(chunks)))


def logistic(k, x):
    return 1 / (1 + math.exp(-k * x))


def score(a, b, cross=False):
    same = a.text == b.text != ""
    d = 0.0 if same else weighted(distances(a, b))
    topic = logistic(120, 1 - d - 0.66)
    own = [own_distance(t) for t in (a, b)]
    base = None if same or None in own else sum(own) / 2
    p_self = None if base is None else logistic(22, base - d - 0.03)
    used = p_self is not None and p_self > 0.5
    p0 = max(topic, 0.6 * topic + 0.4 * p_self) if used else topic
    least = min(len(a.words), len(b.words))
    f = min(1, math.log10(1 + least) / math.log10(2001)) * (0.8 if least < 150 else 1) * (0.7 if cross else 1) * (0.9 if used and topic < 0.35 else 1)
    f = 1.0 if same else f
    p = 0.5 + (p0 - 0.5) * f
    p = min(0.999, max(0.001, max(p, 0.99) if same else p))
    verdict = "same_high" if p >= 0.85 else "same_medium" if p >= 0.65 else "inconclusive" if p > 0.35 else "diff_medium" if p > 0.15 else "diff_high"
    codes = [(len(a.words) < 500, "short_1"), (len(b.words) < 500, "short_2"), (least < 150, "critical"), (cross, "cross_script"), (used and topic < 0.35, "self_unstable"), (same, "identical")]
    return {"D": d, "S": 1 - d, "p_topic": topic, "self_distance": base, "p_self": p_self, "p0": p0, "f": f, "p": p, "margin": 0.03 + 0.25 * (1 - f), "verdict": verdict, "warnings": [c for on, c in codes if on], "identical": same}


def reasons(found, p):
    """(part, nth, metric, distance): what speaks for and against one author."""
    held = [(d, i) for i, d in enumerate(found, 1) if d is not None]
    near, far = sorted(x for x in held if x[0] <= 0.5), sorted(x for x in held if x[0] >= 0.5)
    alike, different = near or sorted(held, reverse=True), far or sorted(held)
    many = (3, 0) if p >= 0.65 else (0, 3) if p <= 0.35 else (2, 2)
    return [(part, n, f"M{i}", d) for part, rows, k in (("alike", alike, many[0]), ("different", different, many[1])) for n, (d, i) in enumerate(rows[:k], 1)]


def report(ids, a, b, found, s, names, script="Latin"):
    from decimal import ROUND_HALF_UP, Decimal

    fixed = lambda x, n: str(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))
    lines = [f"M{i}".ljust(4) + f" {names[f'M{i}']:<28} " + ("neutral" if d is None else f"d={fixed(d, 3)} w={fixed(w, 2)}") for i, (d, w) in enumerate(zip(found, WEIGHTS, strict=True), 1)]
    head = [f"{s['verdict']}: P = {fixed(s['p'] * 100, 1)}% +- {fixed(s['margin'] * 100, 1)}%"]
    head += [f"text {n}: untitled (id {i}), {len(t.words)} words, script {script}, charset given as text" for n, i, t in ((1, ids[0], a), (2, ids[1], b))]
    sums = [f"D {fixed(s['D'], 3)}, S {fixed(s['S'], 3)}, P(topic) {fixed(s['p_topic'], 3)}"]
    if s["p_self"] is not None and s["p_self"] > 0.5 and s["p0"] > s["p_topic"] + 1e-9:
        sums.append(f"self distance {fixed(s['self_distance'], 3)}, P(self) {fixed(s['p_self'], 3)}")
    sums.append(f"P0 {fixed(s['p0'], 3)}, f {fixed(s['f'], 3)}")
    why = [f"{part}: {names[m]} ({fixed(d, 3)})" for part, _, m, d in reasons(found, s["p"])]
    warn = ["warnings: " + ", ".join(s["warnings"])] if s["warnings"] else []
    return "\n\n".join("\n".join(x) for x in (head, lines, sums, why, warn) if x)
