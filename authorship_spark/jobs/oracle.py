"""The same results as the registered queries, as SQL for DuckDB.

The test corpus is in Latin script, without marks and in NFC, so a token is a run
of letters and digits here. Views build on each other; a query's SQL is the views
it needs and one SELECT.
"""

from __future__ import annotations

import re

from ..operators.metrics import NAMES

_HABITS = "['space_before_mark','double_space','three_dots','ellipsis','em_dash','hyphen_dash','en_dash','straight_quote','guillemets','curly_quotes','apostrophe','emoji_caps']"
_MARKS = ",.!?;:«»\"'()—–…-"


def _found(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _one(mark: str) -> str:
    quoted = mark.replace("'", "''")
    return f"(length(text) - length(replace(text, '{quoted}', '')))"


def _grams(n: int) -> str:
    columns = ", ".join(f"c[{k}:len(c) - {n - k}]" for k in range(1, n + 1))
    joined = " || ".join(f"x[{k}]" for k in range(1, n + 1))
    return f"CASE WHEN len(c) >= {n} THEN list_transform(list_zip({columns}), lambda x: {joined}) ELSE [] END"


def _hist(values: str, bins: int) -> str:
    return f"list_transform(range(1, {bins + 1}), lambda b: len(list_filter({values}, lambda v: least(v, {bins}) = b)) / greatest(len({values}), 1))"


def _cut(i: int, prev: str) -> dict[str, str]:
    """The i-th cut of every text with more than i chunks: its best break, and the texts with it."""
    target = f"CAST(floor(CAST(n AS DOUBLE) * {i} / k + 0.5) AS BIGINT)"
    span = "greatest(1, n // 8)"
    return {
        f"b{i}": f"SELECT doc_id, arg_min(i, (w * abs(i - {target}), i)) AS best FROM {prev} JOIN br USING (doc_id) "
        f"WHERE k > {i} AND i >= greatest(cut{i - 1} + 1, {target} - {span}) AND i <= least(n - 1, {target} + {span}) GROUP BY doc_id",
        f"k{i}": f"SELECT p.*, CASE WHEN k > {i} THEN CASE WHEN coalesce(best, {target}) <= cut{i - 1} OR coalesce(best, {target}) >= n "
        f"THEN greatest(cut{i - 1} + 1, least({target}, n - 1)) ELSE coalesce(best, {target}) END END AS cut{i} FROM {prev} p LEFT JOIN b{i} USING (doc_id)",
    }


def _cosine(ab: str, aa: str, bb: str, zero: str = "0") -> str:
    return f"CASE WHEN {aa} = 0 AND {bb} = 0 THEN {zero} WHEN {aa} = 0 OR {bb} = 0 THEN 0 ELSE {ab} / (sqrt({aa}) * sqrt({bb})) END"


def _kl(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * ln({p} / (({p} + {q}) / 2)) ELSE 0 END"


def _jsd(where: str, p: str, q: str) -> str:
    kl = lambda a, b: f"coalesce(sum({_kl(a, b)}) FILTER ({where}), 0)"
    total = lambda x: f"coalesce(sum({x}) FILTER ({where}), 0) <= 0"
    return f"CASE WHEN {total(p)} AND {total(q)} THEN 0 WHEN {total(p)} OR {total(q)} THEN 0.5 ELSE least(1, (0.5 * {kl(p, q)} + 0.5 * {kl(q, p)}) / ln(2)) END"


def _sums(where: str, p: str, q: str) -> str:
    total = lambda x: f"coalesce(sum({x}) FILTER ({where}), 0)"
    return _cosine(total(f"{p} * {q}"), total(f"{p} * {p}"), total(f"{q} * {q}"))


def _jsd_lists(p: str, q: str) -> str:
    kl = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: {_kl('x[1]', 'x[2]')}))"
    return f"CASE WHEN list_sum({p}) <= 0 AND list_sum({q}) <= 0 THEN 0 WHEN list_sum({p}) <= 0 OR list_sum({q}) <= 0 THEN 0.5 ELSE least(1, (0.5 * {kl(p, q)} + 0.5 * {kl(q, p)}) / ln(2)) END"


def _ks(p: str, q: str) -> str:
    # the parts of both histograms up to each bin
    return f"list_max(list_transform(range(1, len({p}) + 1), lambda i: abs(list_sum({p}[1:i]) - list_sum({q}[1:i]))))"


def _rel(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} <= 0 THEN 0 ELSE abs({a} - {b}) / ({a} + {b}) END"


def _log_rel(a: str, b: str) -> str:
    x, y = f"ln(greatest({a}, 1e-9))", f"ln(greatest({b}, 1e-9))"
    return f"CASE WHEN {x} + {y} = 0 AND {a} + {b} > 0 THEN 0 ELSE abs({x} - {y}) / greatest(1e-9, {x} + {y}) END"


_SMOOTH = "list_transform({v}, lambda x: (x + 0.5) / (list_sum({v}) + 8))"
_LEFT = "rkd > least(CASE WHEN kind = 'c3' THEN 150 ELSE 120 END, greatest(1, (v1 + v2) // 6))"

# Views by name: what each of them is, and it names the views that it reads.
_VIEWS = {
    "d": r"SELECT doc_id, lang, source, regexp_replace(coalesce(text, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS text FROM documents",
    "t": r"SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') AS words, regexp_replace(lower(text), '[^\p{L}]', '', 'g') AS letters, len(regexp_extract_all(text, '\p{L}')) AS nl FROM d",
    "sl": r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[\n.!?…。！？؛۔॥|]'), lambda s: len(regexp_extract_all(s, '[\p{L}\p{M}\p{Nd}]+'))), lambda n: n > 0) AS v FROM d",
    "pl": r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '\n+'), lambda s: len(regexp_extract_all(s, '[\p{L}\p{M}\p{Nd}]+'))), lambda n: n > 0) AS v FROM d",
    "wl": "SELECT doc_id, list_transform(words, lambda w: length(w)) AS v FROM t",
    "pv": "SELECT doc_id, list_transform([" + ", ".join(_one(m) for m in _MARKS) + "], lambda x: x / (greatest(1, nl) / 1000.0)) AS v FROM t",
    "tv": "SELECT doc_id, list_transform(["
    + ", ".join([
        _found("text", r"[ \t\n][,.!?;:]") + " + " + _found("text", r"^[,.!?;:]"),
        "list_sum(list_transform(regexp_extract_all(text, '  +'), lambda x: length(x) - 1))",
        _found("text", r"\.{3,}"), _one("…"), _one("—"), _found("text", "- "), _one("–"), _one('"'), _found("text", "[«»]"), _found("text", "[“”„]"),
        _found(r"regexp_replace(text, '(\p{L})', '\1\1', 'g')", r"\p{L}''\p{L}"),
        _found("text", r"[\x{1F000}-\x{10FFFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}]") + r" + 3 * len(list_filter(regexp_extract_all(text, '\p{L}+[^\p{L}]'), lambda x: regexp_matches(x, '^\p{Lu}{3,}[^\p{L}]$')))",
    ])
    + "], lambda x: coalesce(x, 0) / (greatest(1, nl) / 1000.0)) AS v FROM t",
    "sh": f"SELECT doc_id, {_hist('v', 40)} AS v FROM sl",
    "wh": f"SELECT doc_id, {_hist('v', 15)} AS v FROM wl",
    "ph": f"SELECT doc_id, {_hist('v', 60)} AS v, len(v) AS n FROM pl",
    "kc": "SELECT doc_id, text, length(text) AS n, CASE WHEN len(words) >= 1400 THEN 4 WHEN len(words) >= 700 THEN 3 ELSE 2 END AS k, 0 AS cut0 FROM t WHERE len(words) >= 260",
    "br": "SELECT * FROM (SELECT doc_id, i, CASE WHEN c = chr(10) THEN 0.5 WHEN c IN ('.', '!', '?', '…', '。') THEN 0.75 WHEN c IN (' ', chr(9)) THEN 1.0 END AS w "
    "FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM kc)) WHERE w IS NOT NULL",
    "ce": "SELECT *, list_filter([cut1, cut2, cut3, n], lambda x: x IS NOT NULL) AS e FROM k3",
    "ch": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, substring(text, CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END + 1, e[i] - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END) AS text FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM ce)",
    "ld": "SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM t WHERE len(words) >= 500",
    "pr": "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM ld a JOIN ld b ON a.lang = b.lang AND a.source = b.source AND b.rn BETWEEN a.rn + 1 AND a.rn + 3",
    "ud": "SELECT *, string_split(letters, '') AS c FROM t WHERE doc_id IN (SELECT doc_a FROM pr UNION SELECT doc_b FROM pr)",
    "gw": "SELECT doc_id, 'w' AS kind, unnest(words) AS gram FROM t",
    "gr": "SELECT doc_id, 'w' AS kind, unnest(words) AS gram FROM ud UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, 'c{n}', unnest({_grams(n)}) FROM ud" for n in (1, 2, 3)),
    "wp": "SELECT doc_id, gram, count(*) AS cnt, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS rel FROM gw GROUP BY doc_id, gram",
    "pf": "SELECT doc_id, kind, gram, count(*) AS cnt, count(*) / sum(count(*)) OVER (PARTITION BY doc_id, kind) AS rel FROM gr GROUP BY doc_id, kind, gram",
    "po": "SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY rel DESC, gram) AS own FROM pf",
    "al": "SELECT doc_a, doc_b, kind, gram, sum(r1) AS r1, sum(r2) AS r2, min(o1) AS own1, min(o2) AS own2 FROM ("
    "SELECT doc_a, doc_b, kind, gram, rel AS r1, 0.0::DOUBLE AS r2, own AS o1, NULL AS o2 FROM pr JOIN po ON doc_id = doc_a UNION ALL "
    "SELECT doc_a, doc_b, kind, gram, 0.0::DOUBLE, rel, NULL, own FROM pr JOIN po ON doc_id = doc_b) GROUP BY doc_a, doc_b, kind, gram",
    "rk0": "SELECT *, row_number() OVER (PARTITION BY doc_a, doc_b, kind ORDER BY r1 / 2 + r2 / 2 DESC, gram) AS rk, row_number() OVER (PARTITION BY doc_a, doc_b, kind ORDER BY abs(r1 - r2) DESC, gram) AS rkd, "
    "count(*) FILTER (r1 > 0) OVER (PARTITION BY doc_a, doc_b, kind) AS v1, count(*) FILTER (r2 > 0) OVER (PARTITION BY doc_a, doc_b, kind) AS v2 FROM al",
    "rk1": "SELECT *, " + ", ".join(f"sum(CASE WHEN {cond} THEN r{s} ELSE 0 END) OVER (PARTITION BY doc_a, doc_b, kind) AS s{name}{s}" for name, cond in (("t", "rk <= 300"), ("d", _LEFT)) for s in (1, 2)) + " FROM rk0",
    "rks": "SELECT *, " + ", ".join(f"CASE WHEN s{name}{s} > 0 THEN r{s} / s{name}{s} ELSE 0 END AS {name}{s}" for name in "td" for s in (1, 2)) + f", {_LEFT} AS stays FROM rk1",
    "ku": "SELECT doc_a, doc_b, " + ", ".join([
        f"1 - {_sums(chr(119) + 'here kind = ' + repr('c3') + ' AND rk <= 300', 'r1', 'r2')} AS m1",
        f"1 - {_sums(chr(119) + 'here kind = ' + repr('c2') + ' AND rk <= 250', 'r1', 'r2')} AS m2",
        "coalesce(avg(abs(r1 * 1000.0 - r2 * 1000.0) / (r1 * 1000.0 + r2 * 1000.0 + 0.5)) FILTER (kind = 'w' AND rk <= 100), 0) AS m3",
        f"{_jsd('where kind = ' + repr('w') + ' AND rk <= 300', 't1', 't2')} AS m4",
        f"{_jsd('where kind = ' + repr('c1'), 'r1', 'r2')} AS m5",
        "count(*) FILTER (kind = 'w' AND rk <= 50 AND own1 <= 50 AND own2 <= 50) AS m10_inter",
        "count(*) FILTER (kind = 'w' AND rk <= 50 AND (own1 <= 50 OR own2 <= 50)) AS m10_uni",
        f"0.5 * (1 - ({_sums('where kind = ' + repr('c3'), 'r1', 'r2')})) + 0.5 * ({_jsd('where kind = ' + repr('w'), 'r1', 'r2')}) AS d0",
        f"0.5 * (1 - ({_sums('where kind = ' + repr('c3') + ' AND stays', 'd1', 'd2')})) + 0.5 * ({_jsd('where kind = ' + repr('w') + ' AND stays', 'd1', 'd2')}) AS d1",
        "1 - sum(least(r1, r2)) FILTER (kind = 'c3' AND rk <= 400) / sum(greatest(r1, r2)) FILTER (kind = 'c3' AND rk <= 400) AS m17",
    ]) + " FROM rks GROUP BY doc_a, doc_b",
    "ri": "SELECT doc_id, coalesce(count(gram) / sqrt(sum(cnt)), 0) AS guiraud, coalesce(count(*) FILTER (cnt = 1) / count(gram), 0) AS hapax_ratio, coalesce(1e4 * (sum(cnt * cnt) - sum(cnt)) / (sum(cnt)::DOUBLE * sum(cnt)), 0) AS yule_k, "
    "coalesce(sum(-rel * ln(rel)), 0) AS entropy, count(gram) AS vocab FROM t LEFT JOIN wp USING (doc_id) GROUP BY doc_id",
    "zr": "SELECT doc_id, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, gram) AS rk FROM wp",
    "zs": "SELECT doc_id, coalesce((count(*) FILTER (rk >= 10) * sum(ln(rk) * ln(cnt)) FILTER (rk >= 10) - sum(ln(rk)) FILTER (rk >= 10) * sum(ln(cnt)) FILTER (rk >= 10)) "
    "/ nullif(count(*) FILTER (rk >= 10) * sum(ln(rk) * ln(rk)) FILTER (rk >= 10) - sum(ln(rk)) FILTER (rk >= 10) * sum(ln(rk)) FILTER (rk >= 10), 0), 0) AS zipf_slope FROM zr WHERE rk <= 1000 GROUP BY doc_id",
    "cw": r"SELECT doc_id, chunk_no, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+')) AS gram FROM ch WHERE doc_id IN (SELECT doc_id FROM ud)",
    "cr": "SELECT doc_id, chunk_no, gram, count(*) / sum(count(*)) OVER (PARTITION BY doc_id, chunk_no) AS rel FROM cw GROUP BY doc_id, chunk_no, gram",
    "cn": "SELECT doc_id, count(*) AS k FROM ch GROUP BY doc_id",
    "zp": "SELECT doc_a, doc_b, a.k AS n1, b.k AS n2 FROM pr JOIN cn a ON a.doc_id = doc_a JOIN cn b ON b.doc_id = doc_b",
    "zv": "SELECT doc_a, doc_b, n1, n2, 1 AS side, gram, rel FROM zp JOIN cr ON doc_id = doc_a UNION ALL SELECT doc_a, doc_b, n1, n2, 2, gram, rel FROM zp JOIN cr ON doc_id = doc_b",
    "zm": "SELECT doc_a, doc_b, n1, n2, gram, (coalesce(list_sum(list_sort(list(rel) FILTER (side = 1))), 0) + coalesce(list_sum(list_sort(list(rel) FILTER (side = 2))), 0)) / (n1 + n2) AS mean, "
    "count(*) AS there, count(*) FILTER (side = 1) AS here1, count(*) FILTER (side = 2) AS here2 FROM zv GROUP BY doc_a, doc_b, n1, n2, gram",
    "zt": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY mean DESC, gram) AS rk FROM zm) WHERE rk <= 150",
    "zd": "SELECT doc_a, doc_b, gram, n1, n2, mean, here1, here2, sqrt((sum((rel - mean) * (rel - mean)) + (n1 + n2 - there) * mean * mean) / (n1 + n2 - 1)) AS sd FROM zt JOIN zv USING (doc_a, doc_b, n1, n2, gram) GROUP BY doc_a, doc_b, gram, n1, n2, mean, here1, here2, there",
    "zc": "SELECT doc_a, doc_b, gram, " + ", ".join(
        f"(coalesce(sum(CASE WHEN sd > 0 THEN least(2, greatest(-2, (rel - mean) / sd)) ELSE 0 END) FILTER (side = {s}), 0) + (n{s} - here{s}) * max(CASE WHEN sd > 0 THEN least(2, greatest(-2, -mean / sd)) ELSE 0 END)) / n{s} AS c{s}" for s in (1, 2)
    ) + " FROM zd JOIN zv USING (doc_a, doc_b, n1, n2, gram) GROUP BY doc_a, doc_b, gram, n1, n2, here1, here2",
    "zx": "SELECT doc_a, doc_b, CASE WHEN abs(c1) < 1e-12 THEN 0 ELSE c1 END AS p, CASE WHEN abs(c2) < 1e-12 THEN 0 ELSE c2 END AS q FROM zc",
    "m12": f"SELECT doc_a, doc_b, 1 - ({_cosine('sum(p * q)', 'sum(p * p)', 'sum(q * q)', '1')}) AS m12 FROM zx GROUP BY doc_a, doc_b",
    "sc": r"SELECT doc_id, len(regexp_extract_all(text, '\p{Latin}')) AS n FROM t",
    "fe": "SELECT t.doc_id, len(words) AS n, text, sh.v AS sh, wh.v AS wh, ph.v AS ph, ph.n AS paragraphs, " + _SMOOTH.format(v="pv.v") + " AS pu, tv.v AS ty, guiraud, hapax_ratio, yule_k, entropy, vocab, coalesce(zipf_slope, 0) AS zipf_slope "
    "FROM t JOIN sh USING (doc_id) JOIN wh USING (doc_id) JOIN ph USING (doc_id) JOIN pv USING (doc_id) JOIN tv USING (doc_id) JOIN ri USING (doc_id) LEFT JOIN zs USING (doc_id) WHERE t.doc_id IN (SELECT doc_id FROM ud)",
    "mm": "SELECT pr.doc_a, pr.doc_b, a.n AS n1, b.n AS n2, a.text = b.text AS identical, m1, m2, m3, m4, m5, "
    f"{_ks('a.sh', 'b.sh')} AS m6, {_jsd_lists('a.wh', 'b.wh')} AS m7, {_jsd_lists('a.pu', 'b.pu')} AS m8, "
    f"({_rel('a.guiraud', 'b.guiraud')} + {_rel('a.hapax_ratio', 'b.hapax_ratio')} + {_log_rel('a.yule_k', 'b.yule_k')} + {_log_rel('a.entropy', 'b.entropy')}) / 4 AS m9, "
    "CASE WHEN m10_uni > 0 THEN 1 - m10_inter / m10_uni ELSE 0 END AS m10, "
    f"1 - ({_cosine('list_dot_product(a.ty, b.ty)', 'list_dot_product(a.ty, a.ty)', 'list_dot_product(b.ty, b.ty)', '1')}) AS m11, m12, "
    "CASE WHEN d0 < 0.02 THEN 0 WHEN least(a.n, b.n) >= 800 THEN d1 / d0 END AS m13, CASE WHEN least(a.vocab, b.vocab) >= 30 THEN abs(a.zipf_slope - b.zipf_slope) / 0.30 END AS m14, "
    f"CASE WHEN least(a.paragraphs, b.paragraphs) >= 4 THEN {_ks('a.ph', 'b.ph')} END AS m15, m17 "
    "FROM pr JOIN fe a ON a.doc_id = pr.doc_a JOIN fe b ON b.doc_id = pr.doc_b JOIN ku ON ku.doc_a = pr.doc_a AND ku.doc_b = pr.doc_b LEFT JOIN m12 ON m12.doc_a = pr.doc_a AND m12.doc_b = pr.doc_b",
}
for _i in (1, 2, 3):
    _VIEWS |= _cut(_i, "kc" if _i == 1 else f"k{_i - 1}")
_W = {1: 0.18, 2: 0.12, 3: 0.12, 4: 0.08, 5: 0.04, 6: 0.10, 7: 0.06, 8: 0.12, 9: 0.08, 10: 0.04, 11: 0.06, 12: 0.04, 13: 0.10, 14: 0.04, 15: 0.04, 17: 0.10}
_VIEWS["lg"] = " UNION ALL ".join(f"SELECT doc_a, doc_b, {n} AS metric_no, 'M{n}' AS metric, CASE WHEN m{n} IS NULL THEN 0.5 ELSE least(1, greatest(0, m{n})) END AS distance, {w}::DOUBLE AS weight, m{n} IS NULL AS neutral FROM mm" for n, w in _W.items())
_VIEWS["ds"] = "SELECT doc_a, doc_b, sum(distance * weight) FILTER (NOT neutral) / sum(weight) FILTER (NOT neutral) AS dist FROM lg GROUP BY doc_a, doc_b"
_VIEWS["s1"] = "SELECT doc_a, doc_b, n1, n2, identical, CASE WHEN identical THEN 0 ELSE dist END AS dd, least(1, log10(1 + least(n1, n2)) / log10(2001)) * CASE WHEN least(n1, n2) < 150 THEN 0.8 ELSE 1 END AS f0 FROM mm JOIN ds USING (doc_a, doc_b)"
_VIEWS["s2"] = "SELECT *, 1 / (1 + exp(-120 * (1 - dd - 0.66))) AS pt, CASE WHEN identical THEN 1 ELSE f0 END AS ff FROM s1"
_VIEWS["s3"] = "SELECT *, least(0.999, greatest(0.001, CASE WHEN identical THEN greatest(0.99, 0.5 + (pt - 0.5) * ff) ELSE 0.5 + (pt - 0.5) * ff END)) AS pp FROM s2"
_VIEWS["s4"] = "SELECT *, CASE WHEN pp >= 0.85 THEN 'same_high' WHEN pp >= 0.65 THEN 'same_medium' WHEN pp > 0.35 THEN 'inconclusive' WHEN pp > 0.15 THEN 'diff_medium' ELSE 'diff_high' END AS verdict FROM s3"
_VIEWS["ra"] = (
    "SELECT lg.*, CASE WHEN pp >= 0.65 THEN 3 WHEN pp <= 0.35 THEN 0 ELSE 2 END AS wa, CASE WHEN pp >= 0.65 THEN 0 WHEN pp <= 0.35 THEN 3 ELSE 2 END AS wd, "
    "count(*) FILTER (distance <= 0.5) OVER (PARTITION BY doc_a, doc_b) AS na, count(*) FILTER (distance >= 0.5) OVER (PARTITION BY doc_a, doc_b) AS nd FROM lg JOIN s3 USING (doc_a, doc_b) WHERE NOT neutral"
)

_REFERENCE = re.compile(r"\b(FROM|JOIN) (\(?)(\w+)\b(?! +(?!JOIN|LEFT|WHERE|ON|USING|GROUP|UNION|ORDER|HAVING)\w)|\b(FROM|JOIN) (\(?)(\w+)\b")


def _rebased(prefix: str, base: dict[str, str]) -> dict[str, str]:
    """All views again under a prefix, over other documents and pairs (``base`` has the views d and pr)."""

    def again(found: re.Match) -> str:
        word, bracket, name, aliased = found[1] or found[4], found[2] or found[5] or "", found[3] or found[6], found[6] is not None
        return found[0] if name not in _VIEWS else f"{word} {bracket}{prefix}{name}" + ("" if aliased else f" AS {name}")

    return {prefix + name: base.get(name) or _REFERENCE.sub(again, body) for name, body in _VIEWS.items()}


# chunks of long documents as documents of their own, with all pairs inside a document...
_WITHIN = _rebased("c_", {
    "d": r"SELECT doc_id * 4 + chunk_no AS doc_id, NULL AS lang, NULL AS source, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS text FROM ch WHERE text <> '' AND doc_id IN (SELECT doc_id FROM ld)",
    "pr": "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM c_t a JOIN c_t b ON a.doc_id // 4 = b.doc_id // 4 AND a.doc_id < b.doc_id "
    "WHERE a.doc_id // 4 IN (SELECT doc_id // 4 FROM c_t GROUP BY doc_id // 4 HAVING count(*) >= 2 AND min(len(words)) >= 100)",
})
# ...and their first two, paired with each other and the first ones of neighbours
_ACROSS = _rebased("e_", {
    "d": r"SELECT doc_id * 4 + chunk_no AS doc_id, NULL AS lang, NULL AS source, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS text FROM ch WHERE chunk_no < 2 AND doc_id IN (SELECT doc_id FROM ld)",
    "pr": "SELECT doc_id - 1 AS doc_a, doc_id AS doc_b FROM e_t WHERE doc_id % 4 = 1 UNION ALL SELECT doc_a * 4, doc_b * 4 FROM pr",
})
# each labelled document with its predecessor, of whatever length
_LISTED = _rebased("l_", {
    "d": _VIEWS["d"],
    "pr": "SELECT doc_id AS doc_a, doc_id - 1 AS doc_b FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id - 1 IN (SELECT doc_id FROM documents)",
})
# groups with all kinds of pairs: neighbours' first chunks, and copies
_KINDS = _rebased("f_", {"d": _ACROSS["e_d"], "pr": "SELECT DISTINCT doc_a, doc_b FROM f_lb"})
_VIEWS |= _WITHIN | _ACROSS | _LISTED | _KINDS
_VIEWS["nx"] = "SELECT *, row_number() OVER (PARTITION BY doc_a ORDER BY doc_b) AS nth FROM pr"
_VIEWS["cp"] = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM ld"
_VIEWS["f_lb"] = (
    "SELECT doc_id - 1 AS doc_a, doc_id AS doc_b, doc_id // 4 AS g, 'AA' AS kind FROM f_t WHERE doc_id % 4 = 1 "
    "UNION ALL SELECT doc_a * 4, doc_b * 4, doc_a, CASE nth WHEN 1 THEN 'AB' ELSE 'AC' END FROM nx WHERE nth <= 2 "
    "UNION ALL SELECT x.doc_b * 4, y.doc_b * 4, x.doc_a, 'BC' FROM nx x JOIN nx y ON x.doc_a = y.doc_a AND x.nth = 1 AND y.nth = 2 "
    "UNION ALL SELECT first * 4, doc_id * 4, doc_id, 'II' FROM cp WHERE first < doc_id"
)
# a report: its heading, metrics, sums, reasons and warnings
_NAMED = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{name}'" for m, name in NAMES.items()) + " END"
_VIEWS["rl"] = (
    f"SELECT doc_a, doc_b, string_agg(rpad(metric, 4, ' ') || ' ' || rpad({_NAMED}, 28, ' ') || ' ' || CASE WHEN neutral THEN 'neutral' ELSE printf('d=%.3f w=%.2f', round(distance, 3), weight) END, chr(10) ORDER BY metric_no) AS lines "
    "FROM (SELECT doc_a, doc_b, metric_no, metric, distance, weight, neutral FROM lg UNION ALL SELECT doc_a, doc_b, 16, 'M16', 0.5, 0.10, true FROM pr) GROUP BY doc_a, doc_b"
)
_VIEWS["rn"] = (
    "SELECT *, 'alike' AS part, wa AS want, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance, metric_no) AS nth FROM ra WHERE na > 0 AND distance <= 0.5 UNION ALL "
    "SELECT *, 'alike', wa, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance DESC, metric_no DESC) FROM ra WHERE na = 0 UNION ALL "
    "SELECT *, 'different', wd, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance, metric_no) FROM ra WHERE nd > 0 AND distance >= 0.5 UNION ALL "
    "SELECT *, 'different', wd, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance, metric_no) FROM ra WHERE nd = 0"
)
_VIEWS["rw"] = f"SELECT doc_a, doc_b, string_agg(part || ': ' || {_NAMED} || ' (' || printf('%.3f', round(distance, 3)) || ')', chr(10) ORDER BY part, nth) AS why FROM rn WHERE nth <= want GROUP BY doc_a, doc_b"
# letters a to z, or a to m, in another script; a table of these scripts' letters
_FIRST = {"TIFINAGH": 0x2D30, "YI": 0xA000, "CANADIAN_ABORIGINAL": 0x1401, "NKO": 0x07CA, "CYRILLIC": 0x0430, "HAN": 0x4E00}
_CASES = " ".join(
    f"WHEN {2 * k + half} THEN translate(text, 'abcdefghijklmnopqrstuvwxyz'[1:{26 // (half + 1)}], '{''.join(map(chr, range(first, first + 26 // (half + 1))))}')"
    for k, first in enumerate(_FIRST.values()) for half in (0, 1)
)
_VIEWS["sx"] = f"SELECT doc_id, CASE doc_id % {2 * len(_FIRST)} {_CASES} ELSE text END AS text FROM d"
_VIEWS["sr"] = "SELECT * FROM (VALUES (65, 90, 'LATIN'), (97, 122, 'LATIN'), (170, 170, 'LATIN'), (186, 186, 'LATIN'), (192, 214, 'LATIN'), (216, 246, 'LATIN'), (248, 591, 'LATIN'), " + ", ".join(f"({first}, {first + 25}, '{s}')" for s, first in _FIRST.items()) + ") AS r(lo, hi, script)"
_VIEWS["sy"] = r"SELECT doc_id, script, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^\p{L}]', '', 'g'), '')) AS c FROM sx) JOIN sr ON unicode(c) BETWEEN lo AND hi GROUP BY doc_id, script"
_VIEWS["sz"] = "SELECT doc_id, arg_min(script, (-n, script)) AS dominant_script FROM sy GROUP BY doc_id"
_VIEWS["sd"] = "SELECT doc_a // 4 AS doc_id, avg(dist) AS own FROM c_ds GROUP BY doc_a // 4"
_VIEWS["q1"] = "SELECT s2.*, CASE WHEN NOT identical THEN (a.own + b.own) * 0.5 END AS sf FROM s2 LEFT JOIN sd a ON a.doc_id = doc_a LEFT JOIN sd b ON b.doc_id = doc_b"
_VIEWS["q2"] = "SELECT *, 1 / (1 + exp(-22 * (sf - dd - 0.03))) AS ps FROM q1"
_VIEWS["q3"] = "SELECT *, CASE WHEN ps > 0.5 THEN greatest(pt, 0.6 * pt + 0.4 * ps) ELSE pt END AS p0, coalesce(ps > 0.5 AND pt < 0.35, false) AS unstable FROM q2"
_VIEWS["q4"] = "SELECT *, CASE WHEN identical THEN 1 ELSE f0 * CASE WHEN unstable THEN 0.9 ELSE 1 END END AS f9 FROM q3"
_VIEWS["q5"] = "SELECT *, least(0.999, greatest(0.001, CASE WHEN identical THEN greatest(0.99, 0.5 + (p0 - 0.5) * f9) ELSE 0.5 + (p0 - 0.5) * f9 END)) AS p9 FROM q4"

_VERDICT = "CASE WHEN {p} >= 0.85 THEN 'same_high' WHEN {p} >= 0.65 THEN 'same_medium' WHEN {p} > 0.35 THEN 'inconclusive' WHEN {p} > 0.15 THEN 'diff_medium' ELSE 'diff_high' END"
_FORMATS = "PNG JPEG GIF WebP WAV BMP TIFF TIFF ICO PDF ZIP RAR 7Z GZIP OGG FLAC MP4/MOV MP3 MP3 ELF PE MS_Office SQLite".replace("_", " ").split(" ")
_ELEMENTS = "SELECT doc_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS idx, {value} AS value FROM {view}"


def _sql(select: str) -> str:
    """``select`` behind the views that it needs, each after those it reads itself."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN) \(?(\w+)", text):
            if name in _VIEWS and name not in order:
                need(_VIEWS[name])
                order.append(name)

    need(select)
    parts = [f"{name} AS ({_VIEWS[name]})" for name in order]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def _m(n: int) -> str:
    return f"SELECT doc_a, doc_b, round(CASE WHEN m{n} IS NULL THEN 0.5 ELSE least(1, greatest(0, m{n})) END, 5) AS distance, m{n} IS NULL AS neutral FROM mm"


def oracle_sql() -> dict[str, str]:
    pairs = "SELECT doc_a, doc_b, gram, "
    found = {
        "s2_from_text": "SELECT page_id AS doc_id, coalesce(html, '') AS text FROM pages",
        "s5_decode": "SELECT doc_id, 'UTF-8' AS charset, coalesce(text, '') AS text, NULL::VARCHAR AS reject_reason FROM documents",
        "s6_quarantine": "SELECT doc_id, 'ZIP' AS reject_reason FROM documents",
        "t1_normalize": "SELECT doc_id, text FROM d",
        "t2_tokenize": "SELECT doc_id, CAST(unnest(range(0, len(words))) AS INTEGER) AS idx, unnest(words) AS word FROM t",
        "t3_letters_lower": "SELECT doc_id, letters AS letters_lower FROM t",
        "t4_counts": "SELECT doc_id, CAST(len(words) AS BIGINT) AS word_count, CAST(nl AS BIGINT) AS letter_count FROM t",
        "t5_sentence_lengths": _ELEMENTS.format(value="CAST(unnest(v) AS INTEGER)", view="sl"),
        "t6_paragraph_lengths": _ELEMENTS.format(value="CAST(unnest(v) AS INTEGER)", view="pl"),
        "t7_word_lengths": _ELEMENTS.format(value="CAST(unnest(v) AS INTEGER)", view="wl"),
        "t8_punct_vector": _ELEMENTS.format(value="round(unnest(v), 6)", view="pv"),
        "t9_typo_vector": _ELEMENTS.format(value="round(unnest(v), 6)", view="tv"),
        "t10_top_habit": f"SELECT doc_id, {_HABITS}[list_position(v, list_max(v))] || '=' || printf('%.2f', list_max(v)) AS habit FROM tv",
        "t11_script_counts": "SELECT doc_id, 'LATIN' AS script, CAST(n AS BIGINT) AS n FROM sc WHERE n > 0",
        "t12_dominant_script": "SELECT doc_id, 'LATIN' AS dominant_script FROM sc WHERE n > 0",
        "t13_script_label": "SELECT doc_id, 'Latin' AS label, false AS cjk FROM sc WHERE n > 0",
        "t14_scripts_differ": "SELECT doc_a, doc_b, false AS differ FROM pr",
        "t11_script_counts_mixed": "SELECT doc_id, script, CAST(n AS BIGINT) AS n FROM sy",
        "t12_dominant_script_mixed": "SELECT doc_id, dominant_script FROM sz",
        "t14_scripts_differ_mixed": "SELECT doc_a, doc_b, coalesce(a.dominant_script <> b.dominant_script, false) AS differ FROM pr LEFT JOIN sz a ON a.doc_id = doc_a LEFT JOIN sz b ON b.doc_id = doc_b",
        "j1_pairs_listed": "SELECT doc_a * 2 + nth AS pair_id, doc_a, doc_b, round(m3, 5) AS m3, round(m5, 5) AS m5, round(least(1, greatest(0, m9)), 5) AS m9 FROM l_mm CROSS JOIN (VALUES (0), (1)) AS k(nth)",
        "t15_chunks": "SELECT doc_id, chunk_no, text FROM ch WHERE text <> ''",
        "t16_length_class": "SELECT doc_id, len(words) < 500 AS is_short, len(words) < 150 AS is_critical, CASE WHEN len(words) < 150 THEN 'critical' WHEN len(words) < 500 THEN 'short' ELSE 'full' END AS length_class FROM t",
        "t17_word_stream": "SELECT doc_id, coalesce(list_aggregate(list_transform(words[1:4000], lambda w: w || ' '), 'string_agg', ''), '') AS stream FROM t",
        "a1_word_profile": "SELECT doc_id, gram, cnt FROM wp",
        "a3_rel_freq": "SELECT doc_id, gram, round(rel, 6) AS rel, round(cnt * 1000.0::DOUBLE / sum(cnt) OVER (PARTITION BY doc_id), 6) AS rel_1000 FROM wp",
        "a4_sentence_hist": _ELEMENTS.format(value="round(unnest(v), 6)", view="sh"),
        "a4_word_hist": _ELEMENTS.format(value="round(unnest(v), 6)", view="wh"),
        "a4_paragraph_hist": _ELEMENTS.format(value="round(unnest(v), 6)", view="ph"),
        "a5_length_stats": "SELECT doc_id, round(coalesce(avg(x), 0), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS sd FROM t LEFT JOIN (SELECT doc_id, unnest(v) AS x FROM sl) USING (doc_id) GROUP BY doc_id",
        "a6_entropy": "SELECT doc_id, round(sum(-p * ln(p)), 6) AS entropy FROM (SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest(string_split(letters, '')) AS g FROM t WHERE letters <> '') GROUP BY doc_id, g) GROUP BY doc_id",
        "a7_richness": "SELECT doc_id, round(guiraud, 6) AS guiraud, round(hapax_ratio, 6) AS hapax_ratio, round(yule_k, 6) AS yule_k, round(entropy, 6) AS entropy, vocab FROM ri",
        "a8_zipf": "SELECT doc_id, round(zipf_slope, 5) AS zipf_slope FROM zs",
        "a9_smooth_props": "SELECT doc_id, CAST(unnest(range(0, 16)) AS INTEGER) AS idx, round(unnest(" + _SMOOTH.format(v="v") + "), 6) AS value FROM pv",
        "j1_pairs_explicit": "SELECT doc_id AS doc_a, doc_id - 1 AS doc_b FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id - 1 IN (SELECT doc_id FROM documents)",
        "j2_pairs": "SELECT doc_a, doc_b FROM pr",
        "j3_identical": "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.text = b.text AND a.text <> '' AS identical FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM d) a "
        "JOIN (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM d) b ON a.lang = b.lang AND b.rn BETWEEN a.rn + 1 AND a.rn + 3",
        "j4_profile_align": pairs + "round(r1, 6) AS r1, round(r2, 6) AS r2 FROM al WHERE kind = 'w'",
        "j5_top_keys": "SELECT * FROM (SELECT doc_id, gram, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, gram) AS INTEGER) AS rk FROM wp) WHERE rk <= 50",
        "j6_top_combined": pairs + "CAST(rk AS INTEGER) AS rk FROM rk0 WHERE kind = 'w' AND rk <= 100",
        "j7_restrict_renorm": pairs + "round(t1, 6) AS t1, round(t2, 6) AS t2 FROM rks WHERE kind = 'w' AND rk <= 300",
        "j8_top_diff": pairs + "CAST(rkd AS INTEGER) AS rkd FROM rk0 WHERE kind = 'w' AND rkd <= 120",
        "j9_drop_keys": pairs + "round(coalesce(r1 / nullif(sum(r1) OVER (PARTITION BY doc_a, doc_b), 0), 0), 6) AS d1, round(coalesce(r2 / nullif(sum(r2) OVER (PARTITION BY doc_a, doc_b), 0), 0), 6) AS d2 FROM rk0 WHERE kind = 'w' AND rkd > 120",
        "j10_key_sets": "SELECT doc_a, doc_b, count(*) FILTER (own1 <= 50 AND own2 <= 50) AS inter, count(*) FILTER (own1 <= 50 OR own2 <= 50) AS uni FROM rk0 WHERE kind = 'w' AND rk <= 50 GROUP BY doc_a, doc_b",
        "j11_chunk_pairs": "SELECT a.doc_id, a.chunk_no AS chunk_a, b.chunk_no AS chunk_b FROM ch a JOIN ch b ON a.doc_id = b.doc_id AND a.chunk_no < b.chunk_no WHERE a.text <> '' AND b.text <> ''",
        "m1_trigram_cosine": _m(1),
        "r1_distance": "SELECT doc_a, doc_b, round(dist, 5) AS D FROM ds",
        "r9_scores_core": "SELECT doc_a, doc_b, round(dd, 4) AS D, round(1 - dd, 4) AS S, round(pt, 4) AS p_topic, round(pt, 4) AS p0, round(ff, 4) AS f, round(pp, 4) AS p, round(0.03 + 0.25 * (1 - ff), 4) AS margin, verdict, "
        "CASE WHEN identical THEN 'identical' ELSE '' END AS warnings, identical FROM s4",
        "x1_metric_table": "SELECT doc_a, doc_b, metric, CASE metric " + " ".join(f"WHEN '{m}' THEN '{name}'" for m, name in NAMES.items()) + " END AS name, round(distance, 5) AS distance, weight, neutral, round(distance * weight, 5) AS contribution FROM lg",
        "x2_rationale": "SELECT doc_a, doc_b, part, CAST(nth AS INTEGER) AS nth, metric FROM ("
        "SELECT *, 'alike' AS part, wa AS want, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance, metric_no) AS nth FROM ra WHERE na > 0 AND distance <= 0.5 UNION ALL "
        "SELECT *, 'alike', wa, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance DESC, metric_no DESC) FROM ra WHERE na = 0 UNION ALL "
        "SELECT *, 'different', wd, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance, metric_no) FROM ra WHERE nd > 0 AND distance >= 0.5 UNION ALL "
        "SELECT *, 'different', wd, row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY distance, metric_no) FROM ra WHERE nd = 0) WHERE nth <= want",
        "r3_self_distance_core": "SELECT doc_id, round(own, 5) AS self_distance FROM sd",
        "r9_scores_self": "SELECT doc_a, doc_b, round(dd, 4) AS D, round(1 - dd, 4) AS S, round(pt, 4) AS p_topic, round(p0, 4) AS p0, round(f9, 4) AS f, round(p9, 4) AS p, round(0.03 + 0.25 * (1 - f9), 4) AS margin, "
        "round(sf, 4) AS self_distance, round(ps, 4) AS p_self, " + _VERDICT.format(p="p9") + " AS verdict, concat_ws(',', CASE WHEN unstable THEN 'self_unstable' END, CASE WHEN identical THEN 'identical' END) AS warnings, identical FROM q5",
        "x4_eval": 'SELECT g AS "group", coalesce(max(pp) FILTER (same) > max(pp) FILTER (NOT same), true) AS passed FROM (SELECT doc_a // 4 AS g, doc_a // 4 = doc_b // 4 AS same, pp FROM e_s3) GROUP BY g',
        "w3_corpus_statistics": "SELECT CASE WHEN nl > 0 THEN 'LATIN' END AS dominant_script, CASE WHEN len(words) < 150 THEN 'critical' WHEN len(words) < 500 THEN 'short' ELSE 'full' END AS length_class, count(*) AS n, CAST(sum(len(words)) AS BIGINT) AS words FROM t GROUP BY ALL",
        "s1_read_files": "SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, count(*) AS records FROM documents GROUP BY source",
        "s3_signature": "SELECT page_id, [" + ", ".join(f"'{f}'" for f in _FORMATS).replace("'MS', 'Office'", "'MS Office'") + "][page_id % 24 + 1] AS signature FROM pages",
        "s4_looks_binary": "SELECT doc_id, CASE WHEN nul > 0 AND nul * 50 >= n THEN 'NUL bytes' WHEN n > 0 AND control * 20 >= n THEN 'control bytes' END AS reason FROM (SELECT doc_id, length(h) AS n, "
        "CASE doc_id % 4 WHEN 0 THEN length(h) - length(replace(h, 'z', '')) WHEN 1 THEN length(h) - length(replace(h, 'w', '')) ELSE 0 END AS nul, "
        "CASE doc_id % 4 WHEN 1 THEN length(h) - length(replace(h, 'a', '')) WHEN 2 THEN length(h) - length(replace(h, 'o', '')) ELSE 0 END AS control "
        r"FROM (SELECT doc_id, left(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g'), 4096) AS h FROM documents))",
        "s5_charsets": "SELECT doc_id, CASE WHEN kind = 3 AND NOT high THEN 'UTF-8' ELSE ['UTF-8', 'UTF-16LE', 'UTF-16BE', 'windows-1251', 'ISO-8859-1'][kind + 1] END AS charset, "
        "CASE kind WHEN 3 THEN translate(plain, 'abvgd', 'абвгд') WHEN 4 THEN translate(plain, 'abvgd', '') || '©' ELSE text END AS text, NULL::VARCHAR AS reject_reason "
        r"FROM (SELECT *, regexp_matches(plain, '[abvgd]') AS high FROM (SELECT doc_id, doc_id % 5 AS kind, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g') AS plain FROM documents))",
        "x4_eval_kinds": "SELECT g AS \"group\", coalesce(max(pp) FILTER (kind = 'AA') > max(pp) FILTER (kind IN ('AB', 'AC', 'BC')), true) AND coalesce(min(pp) FILTER (kind = 'II') >= 0.9, true) AS passed FROM f_lb JOIN f_s3 USING (doc_a, doc_b) GROUP BY g",
        "s8_reports_text": "SELECT doc_a, doc_b, verdict, printf('%s: P = %.1f%% +- %.1f%%', verdict, round(pp * 100, 1), round((0.03 + 0.25 * (1 - ff)) * 100, 1)) || "
        + " || ".join(f"printf(chr(10) || 'text {n}: untitled (id %d), %d words, script Latin, charset given as text', doc_{s}, n{n})" for n, s in ((1, "a"), (2, "b")))
        + " || chr(10) || chr(10) || lines || printf(chr(10) || chr(10) || 'D %.3f, S %.3f, P(topic) %.3f' || chr(10) || 'P0 %.3f, f %.3f', round(dd, 3), round(1 - dd, 3), round(pt, 3), round(pt, 3), round(ff, 3)) "
        "|| coalesce(chr(10) || chr(10) || why, '') || CASE WHEN identical THEN chr(10) || chr(10) || 'warnings: identical' ELSE '' END AS report FROM s4 JOIN rl USING (doc_a, doc_b) LEFT JOIN rw USING (doc_a, doc_b)",
        "s7_scores_written": "SELECT doc_a, doc_b, round(pp, 4) AS p, verdict FROM s4",
        "s7_metrics_written": "SELECT doc_a, doc_b, metric, round(distance, 5) AS distance FROM lg",
        "s8_reports_written": "SELECT verdict, count(*) AS n FROM s4 GROUP BY verdict",
        "x5_summary_core": "SELECT verdict, count(*) AS n, round(avg(pp), 4) AS mean_p FROM s4 GROUP BY verdict",
    }
    found |= {f"a2_char_profile_{n}": f"SELECT doc_id, gram, count(*) AS cnt FROM (SELECT doc_id, unnest({_grams(n)}) AS gram FROM (SELECT doc_id, string_split(letters, '') AS c FROM t WHERE letters <> '')) GROUP BY doc_id, gram" for n in (1, 2, 3)}
    found |= {f"m{n}": _m(n) for n in _W if n > 1}
    return {name: _sql(text) for name, text in found.items()}
