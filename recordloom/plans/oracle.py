"""SQL equivalents (DuckDB) of the registered queries, built from parts."""

from __future__ import annotations

from recordloom.functions import fixed


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def mapping(values: dict[str, str]) -> str:
    return f"MAP({texts(values)}, {texts(values.values())})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda q: q <> '')"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(replace(lower(strip_accents({x})), '&', ' and '), '+', ' and '), '[’''`]', '', 'g'), '[^a-z0-9/\-\s.,#]', ' ', 'g')"


def squeezed(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(range(1, length({x}) + 1), lambda i: i = 1 OR {x}[i] <> {x}[i - 1]), lambda i: {x}[i]), '')"


def phonetic(w: str) -> str:
    """As a scalar subquery, so that w and the rewritten word stand once."""
    t = "w0"
    for pattern, to in fixed.PHONETIC_REWRITES:
        if pattern == "c(?=[eiy])":
            pattern, to = "c([eiy])", r"s\1"
        elif pattern.startswith("(?<="):
            pattern, to = "([kgcjtdpb])h", r"\1"
        t = f"regexp_replace({t}, {text(pattern)}, {text(to)}, 'g')"
    bare = f"regexp_replace({t}, '[aeiouy]', '', 'g')"
    return bare, "coalesce(nullif(%s, ''), w0[1])" % squeezed("b0")


REC = r"""
rec AS (
  SELECT doc_id, (CASE WHEN doc_id % 4 = 0 THEN 'S1' WHEN doc_id % 2 = 0 THEN 'S2' ELSE 'S3' END) || '_' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS entity_id,
         array_to_string(w[1:5], ' ') AS business_name,
         CAST(n_chars AS VARCHAR) || ' ' || array_to_string(w[6:8], ' ') || ', ' || array_to_string(w[9:10], ' ') || ', ' || source AS business_address,
         coalesce(lang, '') AS country
  FROM (SELECT *, string_split(regexp_replace(coalesce(text, ''), '[\t\n\r\x0B\f]', ' ', 'g'), ' ') AS w FROM documents))"""


def noise(x: str) -> str:
    for pattern, to in fixed.NAME_NOISE:
        x = f"regexp_replace({x}, {text('(?i)' + pattern)}, {text(to)}, 'g')"
    return x


def glued(x: str) -> str:
    """Runs of single letters joined: spaces doubled, single letters framed, touching frames merged."""
    framed = f"regexp_replace(' ' || replace({x}, ' ', '  ') || ' ', ' ([a-z]) ', '<\\1>', 'g')"
    return f"replace(replace(replace({framed}, '><', ''), '<', ' '), '>', ' ')"


_bare, _final = phonetic("w")
# every word of a name or address once, with its skeleton
PHON = f"""
low AS (SELECT *, trim(lower(strip_accents(business_name))) AS l FROM rec),
tok AS (
  SELECT *, {words(f"array_to_string(list_transform({words(glued(joined(words('regexp_replace(' + clean(noise('l')) + chr(44) + chr(39) + '[.,/' + chr(92) + '-#]' + chr(39) + chr(44) + chr(39) + ' ' + chr(39) + chr(44) + chr(39) + 'g' + chr(39) + ')'))))}, lambda z: coalesce({mapping(fixed.NAME_ABBREVIATIONS)}[z], z)), ' ')")} AS toks FROM low),
word AS (SELECT DISTINCT unnest(toks) AS w0 FROM tok),
ph AS (SELECT w0 AS w, {_final} AS p FROM (SELECT w0, {_bare} AS b0 FROM word)),
phm AS (SELECT map_from_entries(list((w, p))) AS m FROM ph)"""

NAME = f"""
kept AS (
  SELECT tok.*, m, list_filter(toks, lambda x: NOT list_contains({texts(fixed.LEGAL_WORDS)}, x) AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains({texts(fixed.LEGAL_SKELETONS)}, m[x])) AS k0
  FROM tok, phm),
cored AS (SELECT *, list_transform(list_filter(range(1, len(k0) + 1), lambda i: i = 1 OR k0[i] <> k0[i - 1]), lambda i: k0[i]) AS core FROM kept),
nm AS (
  SELECT entity_id, country, business_name, business_address, core, substr(entity_id, 1, 2) AS src,
    {joined('toks')} AS name_full, {joined('core')} AS name_core, {joined('list_sort(core)')} AS name_sorted,
    {joined('list_transform(core, lambda x: m[x])')} AS name_phon, coalesce(array_to_string(core, ''), '') AS name_concat,
    replace(coalesce(nullif(regexp_extract(l, '(?:www\\.)?([a-z0-9-]+)\\.(?:{fixed.WEB_ENDINGS})\\b', 1), ''), regexp_extract(l, '^[#@]([a-z0-9_]+)$', 1)), '-', '') AS domain,
    {joined(f"list_sort(list_distinct(list_filter(list_transform(toks, lambda x: coalesce({mapping(fixed.LEGAL_CLASSES)}[x], {mapping(fixed.LEGAL_CLASSES)}[m[x]])), lambda x: x IS NOT NULL)))")} AS legal
  FROM cored)"""


def addr_words(part: str) -> str:
    expanded = f"list_transform({words(f'''regexp_replace({part}, '[.#/\\-]', ' ', 'g')''')}, lambda z: coalesce({mapping(fixed.ADDRESS_ABBREVIATIONS)}[z], z))"
    return words(f"array_to_string({expanded}, ' ')")


def plain_words(part: str) -> str:
    return f"list_filter({addr_words(part)}, lambda y: regexp_full_match(y, '[a-z]+') AND length(y) > 1 AND NOT list_contains({texts(fixed.ADDRESS_STOPS)}, y))"


ENT = f"""{REC},{PHON},{NAME},
cl AS (SELECT *, {clean('business_address')} AS c FROM nm),
ad AS (
  SELECT *, list_filter(list_transform(string_split(c, ','), lambda p: trim(p)), lambda p: p <> '') AS parts,
    {addr_words("replace(c, ',', ' ')")} AS aw, list_filter(regexp_extract_all(c, '{fixed.NUMBER}'), lambda n: length(n) <= 8) AS nums FROM cl),
ad2 AS (SELECT *, greatest(coalesce(list_position(list_transform(parts, lambda p: regexp_matches(p, '[0-9]')), true), 0), 1) AS si FROM ad),
ent AS (
  SELECT *, CAST(domain <> '' AND len(core) = 0 AS INTEGER) AS is_domain,
    {joined("aw")} AS addr_full,
    {joined(f"list_filter(aw, lambda x: NOT list_contains({texts(fixed.ADDRESS_STOPS)}, x) AND NOT regexp_matches(x, '^[0-9]'))")} AS addr_words,
    {joined('nums')} AS addr_nums, coalesce(nums[1], '') AS house_no, coalesce(list_filter(nums, lambda n: regexp_full_match(n, '[0-9]{{5,6}}'))[1], '') AS postcode,
    {joined(plain_words("coalesce(parts[si], '')"))} AS street,
    {joined(f"flatten(list_transform(list_filter(range(1, len(parts) + 1), lambda i: i <> si), lambda i: {plain_words('parts[i]')}))")} AS locality,
    regexp_replace(coalesce(nums[1], ''), '[^0-9]', '', 'g') AS house_dig, coalesce(nums[1], '') AS num_tok, coalesce(core[1], '') AS first_tok, len(core) AS n_len
  FROM ad2)"""

_scope = lambda xs, ps, apart=False: f"flatten(list_transform({xs}, lambda x: list_transform({f'list_filter({ps}, lambda p: p <> x)' if apart else ps}, lambda p: x || '@' || p)))"
_tag = lambda t, xs: f"list_transform({xs}, lambda v: '{t}' || v)"
_pair = lambda xs: f"list_transform(range(1, len({xs})), lambda i: {xs}[i] || '_' || {xs}[i + 1])"

KEYS = f"""{ENT},
kw AS (
  SELECT entity_id, country, src, domain, {words('addr_full')} AS at1, core, {words('name_phon')} AS ph1, {words('addr_nums')} AS nu, {words('locality')} AS loc,
    list_filter({words('street')}, lambda s: length(s) >= 4) AS st,
    list_transform(regexp_extract_all(addr_full, '[0-9]+'), lambda g: coalesce(nullif(ltrim(g, '0'), ''), '0')) AS gr FROM ent),
kx AS (
  SELECT *, list_filter(core, lambda t: length(t) >= 3) AS c3, list_filter(ph1, lambda t: length(t) >= 3) AS p3, loc[1:2] AS l2,
    list_transform(list_filter(range(1, len(loc) + 1), lambda i: NOT list_contains(loc[1:i - 1], loc[i])), lambda i: loc[i]) AS ld FROM kw),
ky AS (SELECT *, ld[greatest(len(ld) - 5, 1):len(ld)] AS l6 FROM kx),
kz AS (
  SELECT entity_id, country, src, list_distinct(list_concat(
    {_tag('A:', "list_filter(at1, lambda t: regexp_matches(t, '[0-9]') AND length(t) >= 4)")},
    list_filter(list_transform(range(1, len(at1) + 1), lambda i: CASE WHEN regexp_matches(at1[i], '[0-9]') THEN
      'H:' || at1[i] || '_' || substr(list_filter(at1[i + 1:i + 2], lambda f: regexp_full_match(f, '[a-z]+') AND length(f) > 2)[1], 1, 5) END), lambda k: k IS NOT NULL),
    {_tag('A:', "list_transform(list_filter(nu, lambda n: contains(n, '/') OR length(n) >= 4), lambda n: replace(n, '/', ''))")},
    {_tag('N:', 'c3')}, {_tag('B:', _pair('core'))}, {_tag('P:', 'p3')}, CASE WHEN domain <> '' THEN ['D:' || domain] ELSE [] END,
    {_tag('L:', _scope('c3', 'l2'))}, {_tag('Q:', _scope('p3', 'l2'))}, {_tag('G:', _pair('gr'))},
    {_tag('g:', _scope('list_filter(gr, lambda g: length(g) >= 2)', 'l6'))}, {_tag('W:', _scope('st', 'l6', True))})) AS ks FROM ky),
bkeys AS (SELECT country, src, entity_id AS id, country || '|' || unnest(ks) AS key FROM kz)"""

RARE = f"""{KEYS},
n2 AS (SELECT country, count(*) AS n2 FROM ent WHERE src <> 'S1' GROUP BY country),
kdf AS (SELECT country, key, count(*) AS df FROM bkeys WHERE src <> 'S1' GROUP BY country, key),
rare AS (SELECT country, key, df, ln(1 + n2 / df) AS w FROM kdf JOIN n2 USING (country) WHERE df <= 40),
sc AS (
  SELECT a.country, a.id AS id1, b.id AS id2, sum(r.w) AS sim FROM bkeys a JOIN bkeys b ON a.country = b.country AND a.key = b.key AND a.src = 'S1' AND b.src <> 'S1'
  JOIN rare r ON r.country = a.country AND r.key = a.key GROUP BY 1, 2, 3),
kc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, id1 ORDER BY round(sim, 9) DESC, id2) - 1 AS rank FROM sc) WHERE rank < 30)"""

VECS = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings),
s1 AS (SELECT * FROM v WHERE id % 4 = 0), s2 AS (SELECT * FROM v WHERE id % 4 <> 0)"""


def top(a: str, b: str, k: int, name: str, extra: str = "") -> str:
    return f"""{name} AS (SELECT id1, id2, sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY sim DESC, id2) - 1 AS rank FROM (
    SELECT a.id AS id1, b.id AS id2, list_dot_product(a.vec, b.vec) AS sim FROM {a} a, {b} b)) WHERE rank < {k} {extra})"""


SCORED = f"{VECS}, {top('s1', 's2', 8, 'fw')}, sp AS (SELECT id1, id2, round((sim + 1) / 2, 6) AS p FROM fw)"
TRUE = "tr AS (SELECT a.id AS id1, b.id AS id2 FROM s1 a JOIN s2 b ON a.label = b.label AND (a.id // 4) % 10 = b.id % 10)"
OWN = "ex AS (SELECT id1, id2, p FROM (SELECT *, row_number() OVER (PARTITION BY id2 ORDER BY p DESC, id1) AS r FROM sp) WHERE r = 1)"
EF = """er AS (
  SELECT *, row_number() OVER o AS k, sum(p) OVER (PARTITION BY id1 ORDER BY p DESC, id2 ROWS UNBOUNDED PRECEDING) AS head,
    sum(p) OVER (PARTITION BY id1) AS tot, product(1 - p) OVER (PARTITION BY id1) AS none
  FROM ex WHERE p >= 0.05 WINDOW o AS (PARTITION BY id1 ORDER BY p DESC, id2)),
ee AS (SELECT *, 1.25 * head / (0.25 * tot + k) AS ef FROM er),
eb AS (SELECT id1, max(ef) AS best FROM ee GROUP BY id1),
ek AS (SELECT ee.id1, min(k) AS kk FROM ee JOIN eb ON ee.id1 = eb.id1 AND ef = best GROUP BY ee.id1),
xf AS (SELECT ee.id1, ee.id2, ee.p FROM ee JOIN eb USING (id1) JOIN ek USING (id1) WHERE best > none AND k <= kk)"""


def scores(pred: str, name: str = "es") -> str:
    return f"""{name} AS (
  SELECT id1, tp, n_pred, n_true, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 OR tp = 0 THEN 0.0
    ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + (tp / n_true)) END AS f
  FROM (SELECT s1.id AS id1, (SELECT count(*) FROM {pred} q JOIN tr USING (id1, id2) WHERE q.id1 = s1.id) AS tp,
    (SELECT count(*) FROM {pred} q WHERE q.id1 = s1.id) AS n_pred, (SELECT count(*) FROM tr WHERE tr.id1 = s1.id) AS n_true FROM s1))"""


KPAIRS = f"{RARE}, pr AS (SELECT country, id1, id2 FROM kc), pe AS (SELECT pr.*, l, r FROM pr JOIN ent l ON l.entity_id = id1 JOIN ent r ON r.entity_id = id2)"


def overlap(col: str) -> tuple[str, str, str]:
    a, b = (f"list_distinct({words(f'{s}.{col}')})" for s in "lr")
    inter = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {inter})"
    return (
        f"round(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE -1.0 END, 6)",
        f"round(CASE WHEN least(len({a}), len({b})) > 0 THEN {inter} / least(len({a}), len({b})) ELSE -1.0 END, 6)",
        f"CAST({inter} AS DOUBLE)",
    )


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_jac = {c: overlap(c) for c in ("name_core", "name_phon", "addr_words", "addr_nums", "street", "locality", "legal")}
_both = "l.house_dig <> '' AND r.house_dig <> ''"
_known = lambda ok, v: f"CASE WHEN {ok} THEN CAST({v} AS DOUBLE) ELSE -1.0 END"

_TFIDF = """
c AS (SELECT country, id, term, count(*) AS c FROM g GROUP BY ALL),
d AS (SELECT country, term, count(*) AS df FROM c GROUP BY ALL),
n AS (SELECT country, count(*) AS n FROM ent GROUP BY ALL),
x AS (SELECT c.country, id, c.term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN d ON c.country = d.country AND c.term = d.term JOIN n ON n.country = c.country),
w AS (SELECT country, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY country, id)) AS w FROM x)"""
_pad = f"' ' || array_to_string({words('name_core')}, '  ') || ' '"
_CHARS = f"""{ENT},
pd AS (SELECT country, entity_id AS id, CASE WHEN name_core = '' THEN '' ELSE substr({_pad}, 1, 256) END AS t FROM ent),
g AS (
  SELECT country, id, unnest(list_concat(
    list_transform(list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda s: s <> '  '), lambda s: '2:' || s),
    list_transform(list_filter(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), lambda s: NOT contains(substr(s, 2, 1), ' ')), lambda s: '3:' || s),
    list_transform(list_filter(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)), lambda s: NOT contains(substr(s, 2, 2), ' ')), lambda s: '4:' || s))) AS term FROM pd),{_TFIDF}"""
_WORDS = f"""{ENT},
pd AS (SELECT country, entity_id AS id, {words('addr_words')} AS w1 FROM ent),
g AS (SELECT country, id, unnest(list_concat(w1, list_transform(range(1, len(w1)), lambda i: w1[i] || ' ' || w1[i + 1]))) AS term FROM pd),{_TFIDF}"""

def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns of at most 120 characters, a row of its table in the bits of a number."""
    full = f"((1::HUGEINT << length({a})::INTEGER) - 1)"
    places = f"list_transform(string_split({b}, ''), lambda ch: coalesce(list_sum(list_transform(list_filter(range(1, length({a}) + 1), lambda i: {a}[i] = ch), lambda i: 1::HUGEINT << (i - 1)::INTEGER)), 0)::HUGEINT)"
    return f"(length({a}) - bit_count(list_reduce({places}, lambda w, m: ((w + (w & m)) | (w - (w & m))) & {full}, {full})))"


def indel(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2 * {lcs(a, b)} / (length({a}) + length({b})) END"


_own = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda q: NOT list_contains({y}, q))), ' ')"
# similarities of each different pair of names; windows of the longer name, cut at the ends
FUZZY = f"""
fz0 AS (SELECT DISTINCT l.name_full AS fa, r.name_full AS fb, l.name_core AS ca, r.name_core AS cb FROM pe),
ts0 AS (SELECT DISTINCT fa, fb, list_distinct({words('fa')}) AS x, list_distinct({words('fb')}) AS y FROM fz0),
ts1 AS (SELECT fa, fb, len(x) AS nx, len(y) AS ny, coalesce(array_to_string(list_sort(list_intersect(x, y)), ' '), '') AS s, coalesce({_own('x', 'y')}, '') AS ox, coalesce({_own('y', 'x')}, '') AS oy FROM ts0),
ts2 AS (SELECT *, trim(s || ' ' || ox) AS p, trim(s || ' ' || oy) AS q FROM ts1),
ts AS (SELECT fa, fb, CASE WHEN nx = 0 OR ny = 0 THEN 0.0 WHEN s <> '' AND (ox = '' OR oy = '') THEN 1.0
  ELSE greatest({indel('p', 'q')}, CASE WHEN s <> '' THEN greatest(2 * length(s) / (length(s) + length(p)), 2 * length(s) / (length(s) + length(q))) ELSE 0 END) END AS rf_token_set FROM ts2),
pt0 AS (SELECT DISTINCT ca, cb FROM fz0),
pt1 AS (SELECT ca, cb, CASE WHEN length(ca) <= length(cb) THEN ca ELSE cb END AS sh, CASE WHEN length(ca) <= length(cb) THEN cb ELSE ca END AS lo FROM pt0
  UNION ALL SELECT ca, cb, cb, ca FROM pt0 WHERE length(ca) = length(cb)),
pt2 AS (SELECT DISTINCT ca, cb, sh, unnest(list_transform(range(1 - length(sh), length(lo)), lambda i: substr(lo, greatest(i, 0) + 1, i + length(sh) - greatest(i, 0)))) AS win FROM pt1 WHERE sh <> '' AND lo <> ''),
pt3 AS (SELECT ca, cb, max({indel('sh', 'win')}) AS best FROM pt2 GROUP BY ca, cb),
pt AS (SELECT ca, cb, coalesce(best, CASE WHEN ca = '' AND cb = '' THEN 1.0 ELSE 0.0 END) AS rf_partial FROM pt0 LEFT JOIN pt3 USING (ca, cb))"""
_jaro = "CASE WHEN l.name_core = r.name_core THEN 1.0 WHEN l.name_core = '' OR r.name_core = '' THEN 0.0 ELSE jaro_winkler_similarity(l.name_core, r.name_core) END"
_fuzzy_join = "JOIN ts ON ts.fa = l.name_full AND ts.fb = r.name_full JOIN pt ON pt.ca = l.name_core AND pt.cb = r.name_core"


def char_grams(t: str, ns: tuple[int, ...], by_word: bool = True) -> str:
    """Terms of a column that is padded already."""
    out = []
    for n in ns:
        inner = "true" if not by_word or n == 1 else "s <> '  '" if n == 2 else f"NOT contains(substr(s, 2, {n - 2}), ' ')"
        out.append(f"list_transform(list_filter(list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, i, {n})), lambda s: {inner}), lambda s: '{n}:' || s)")
    return f"list_concat({', '.join(out)})"


def _cosine_terms(name: str, one: str, two: str, ns: tuple[int, ...], by_word: bool = True) -> str:
    t = f"CASE WHEN src = 'S1' THEN {one} ELSE {two} END"
    if not ns:  # words, with pairs of neighbours where by_word
        terms = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))" if by_word else "t"
        return f"SELECT '{name}' AS f, country, id, unnest({terms}) AS term FROM (SELECT country, entity_id AS id, {words(t)} AS t FROM nd)"
    body = f"array_to_string({words('u')}, '  ')" if by_word else "u"
    padded = f"SELECT country, id, CASE WHEN u = '' THEN '' ELSE substr(' ' || {body} || ' ', 1, 256) END AS t FROM (SELECT country, entity_id AS id, {t} AS u FROM nd)"
    return f"SELECT '{name}' AS f, country, id, unnest({char_grams('t', ns, by_word)}) AS term FROM ({padded})"


_usual = (2, 3, 4)
_cosines = {
    "n_char": ("name_core", "name_core", _usual), "n_full_char": ("name_full", "name_full", _usual), "n_phon": ("name_phon", "name_phon", (1, 2, 3)),
    "n_word": ("name_core", "name_core", (), False), "n_sorted": ("name_sorted", "name_sorted", (3,)),
    "n_concat": ("name_concat", "CASE WHEN domain <> '' THEN domain ELSE name_concat END", (3,), False),
    "a_char": ("addr_full", "addr_full", _usual), "a_word": ("addr_words", "addr_words", ()), "street_char": ("street", "street", _usual),
    "n_distinct_char": ("name_distinct", "name_distinct", _usual),
}
_distinct = joined(f"list_filter(core, lambda x: NOT list_contains({words('street')}, x) AND NOT list_contains({words('locality')}, x))")
COSINES = f"""
nd AS (SELECT *, {_distinct} AS name_distinct FROM ent),
g AS ({' UNION ALL '.join(_cosine_terms(n, *args) for n, args in _cosines.items())}),
c AS (SELECT f, country, id, term, count(*) AS c FROM g GROUP BY ALL),
d AS (SELECT f, country, term, count(*) AS df FROM c GROUP BY ALL),
n AS (SELECT country, count(*) AS n FROM ent GROUP BY ALL),
x AS (SELECT c.f, c.country, id, c.term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN d ON c.f = d.f AND c.country = d.country AND c.term = d.term JOIN n ON n.country = c.country),
w AS (SELECT f, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY f, id)) AS w FROM x),
co AS (SELECT pr.id1, pr.id2, a.f, sum(a.w * b.w) AS s FROM pr JOIN w a ON a.id = pr.id1 JOIN w b ON b.id = pr.id2 AND b.f = a.f AND b.term = a.term GROUP BY 1, 2, 3),
cw AS (SELECT pr.id1, pr.id2, {', '.join(f"coalesce(max(s) FILTER (f = '{n}'), 0.0) AS {n}" for n in _cosines)} FROM pr LEFT JOIN co USING (id1, id2) GROUP BY 1, 2)"""


def _pair_features() -> str:
    flag = lambda v: f"CAST({v} AS DOUBLE)"
    out = {n: f"round(cw.{n}, 6)" for n in _cosines}
    for name, column, kept in (
        ("n", "name_core", "jac cont inter"), ("p", "name_phon", "jac cont"), ("a", "addr_words", "jac cont"), ("num", "addr_nums", "jac cont inter"),
        ("street", "street", "jac cont"), ("loc", "locality", "jac"), ("n_distinct", "name_distinct", "jac"), ("lf", "legal", "jac"),
    ):
        got = dict(zip(("jac", "cont", "inter"), overlap(column)))
        out |= {f"{name}_{k}": got[k] for k in kept.split()}
    legal, native = "l.legal <> '' AND r.legal <> ''", r"'[\x{0900}-\x{0D7F}]'"
    best = "greatest(cw.n_char, cw.n_phon, cw.n_concat)"
    out |= {
        "rf_token_set": "round(rf_token_set, 6)", "rf_partial": "round(rf_partial, 6)", "rf_jaro": f"round({_jaro}, 6)",
        "house_eq": _known("l.house_no <> '' AND r.house_no <> ''", "l.house_no = r.house_no"), "house_dig_eq": _known(_both, "l.house_dig = r.house_dig"),
        "house_suffix_eq": _known(_both, "right(l.house_dig, 2) = right(r.house_dig, 2)"), "house_len_diff": _known(_both, "abs(length(l.house_dig) - length(r.house_dig))"),
        "house_lev": _known(_both, "levenshtein(l.house_dig, r.house_dig)"),
        "house_logdiff": f"round({_known(_both, 'ln(1 + abs(CAST(substr(l.house_dig, 1, 9) AS BIGINT) - CAST(substr(r.house_dig, 1, 9) AS BIGINT)))')}, 6)",
        "num_tok_lev": _known("l.num_tok <> '' AND r.num_tok <> ''", "levenshtein(l.num_tok, r.num_tok)"),
        "addr_empty2": flag("trim(r.business_address) = ''"), "lf_eq": _known(legal, "l.legal = r.legal"),
        "lf_conflict": flag(f"{legal} AND len(list_intersect({words('l.legal')}, {words('r.legal')})) = 0"), "lf_empty1": flag("l.legal = ''"), "lf_empty2": flag("r.legal = ''"),
        "native2": flag(f"regexp_matches(r.business_name, {native})"), "addr_native2": flag(f"regexp_matches(r.business_address, {native})"),
        "is_domain2": flag("r.is_domain"), "is_s3": flag("r.src = 'S3'"), "n_len1": flag("l.n_len"), "n_len2": flag("r.n_len"), "n_len_diff": flag("abs(l.n_len - r.n_len)"),
        "dom_in_name": "CASE WHEN r.domain <> '' THEN CAST(contains(l.name_concat, r.domain) AS DOUBLE) ELSE -1.0 END", "n_first_eq": flag("l.first_tok = r.first_tok AND l.first_tok <> ''"),
        **{f"{a}_{b}": "-1.0" for a in ("sim", "rank") for b in ("addr", "both", "name", "rev", "hop")}, "sim_key": "round(kc.sim, 6)", "rank_key": "kc.rank", "n_passes": "1",
        "name_best": f"round({best}, 6)", "name_x_addr": f"round({best} * CASE WHEN trim(r.business_address) = '' THEN 0.5 ELSE cw.a_char END, 6)",
    }
    ctes = f"{RARE}, pr AS (SELECT country, id1, id2 FROM kc), {COSINES.strip()}, pe AS (SELECT pr.*, l, r FROM pr JOIN nd l ON l.entity_id = id1 JOIN nd r ON r.entity_id = id2)"
    columns = ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in out.items())
    return with_(f"{ctes},{FUZZY}", f"SELECT pe.country, pe.id1, pe.id2, {columns} FROM pe JOIN cw ON cw.id1 = pe.id1 AND cw.id2 = pe.id2 JOIN kc ON kc.id1 = pe.id1 AND kc.id2 = pe.id2 {_fuzzy_join}")


def crc(x: str) -> str:
    """CRC-32 of an ASCII string: its bytes, each followed by seven zeros, are taken in a bit at a time."""
    steps = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: list_concat([ord({x}[i])::BIGINT], [0, 0, 0, 0, 0, 0, 0]::BIGINT[])))"
    turned = lambda c: f"xor({c} >> 1, CASE WHEN {c} & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce({steps}, lambda c, b: {turned('xor(c, b)')}, 4294967295::BIGINT), 4294967295)"


_LABELLED = f"""{SCORED}, {TRUE},
lb AS (SELECT sp.id1, sp.id2, (EXISTS (SELECT 1 FROM tr WHERE tr.id1 = sp.id1 AND tr.id2 = sp.id2))::INTEGER AS y FROM sp),
np AS (SELECT sum(y) AS n1, count(*) - sum(y) AS n0 FROM lb),
rp AS (SELECT n1, n0, least(1.0, 0.4 * 400 / greatest(1, n1)) AS pos FROM np),
rn AS (SELECT pos, least(1.0, greatest(0.01, (400 - pos * n1) / greatest(1, n0))) AS neg FROM rp),
ng AS (SELECT id1, id2, y, pos, neg, id1 || '|' || id2 || '|0' AS k FROM lb, rn)"""
_SEARCH = f"""{ENT},
pd AS (SELECT country, entity_id AS id, CASE WHEN addr_full = '' THEN '' ELSE substr(' ' || array_to_string({words('addr_full')}, '  ') || ' ', 1, 256) END AS t FROM ent),
g AS (SELECT country, id, unnest({char_grams('t', (3,))}) AS term FROM pd),{_TFIDF},
va AS (SELECT * FROM w WHERE id LIKE 'S1%'), vb AS (SELECT * FROM w WHERE id NOT LIKE 'S1%'),
ra AS (SELECT country, term FROM vb GROUP BY ALL HAVING count(*) <= 40),
ca AS (SELECT DISTINCT va.country, va.id AS id1, vb.id AS id2 FROM va JOIN ra ON va.country = ra.country AND va.term = ra.term JOIN vb ON vb.country = va.country AND vb.term = va.term),
sm AS (SELECT ca.id1, ca.id2, sum(a.w * b.w) AS sim FROM ca JOIN va a ON a.id = ca.id1 JOIN vb b ON b.id = ca.id2 AND b.term = a.term GROUP BY 1, 2)"""
_mean = "(" + " + ".join(overlap(c)[0] for c in ("name_core", "addr_words")) + ") / 2"
_MATCHED = f"""{KPAIRS}, mp AS (SELECT id1, id2, round({_mean.replace(', 6)', ', 15)')}, 6) AS p FROM pe),
mo AS (SELECT id1, id2 FROM (SELECT *, row_number() OVER (PARTITION BY id2 ORDER BY p DESC, id1) AS r FROM mp) WHERE r = 1 AND p >= 0.4)"""
_PASSES = f"""{VECS}, {top('s1', 's2', 5, 'fw')}, {top('s2', 's1', 3, 'bw')}, {top('s2', 's2', 4, 'hp', 'AND id1 <> id2')},
al AS (SELECT id1, id2, 'name' AS ps, rank, sim FROM fw UNION ALL SELECT id2, id1, 'rev', rank, sim FROM bw
  UNION ALL SELECT fw.id1, hp.id2, 'hop', hp.rank, hp.sim FROM fw JOIN hp ON fw.id2 = hp.id1 WHERE fw.rank < 3)"""
_pass_columns = ", ".join(f"round(max(sim) FILTER (ps = '{p}'), 6) AS sim_{p}, (min(rank) FILTER (ps = '{p}'))::INTEGER AS rank_{p}" for p in ("name", "rev", "hop"))

ORACLES: dict[str, str] = {
    "norm_strip_accents": "SELECT doc_id, strip_accents(coalesce(text, '')) AS plain FROM documents",
    "norm_base_clean": f"SELECT doc_id, {clean(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS cleaned FROM documents",
    "norm_name_views": with_(ENT, "SELECT entity_id, name_full, name_core, name_sorted, name_phon, name_concat, domain, is_domain, n_len::INTEGER AS n_len FROM ent"),
    "norm_phonetic": with_(f"{REC},{PHON}", "SELECT w AS word, p AS skeleton FROM ph"),
    "norm_legal": with_(ENT, "SELECT legal, count(*) AS n FROM ent GROUP BY legal"),
    "norm_address": with_(ENT, "SELECT entity_id, addr_full, addr_words, addr_nums, house_no, postcode, house_dig, num_tok FROM ent"),
    "street_locality": with_(ENT, "SELECT entity_id, street, locality FROM ent"),
    "url_domain": rf"SELECT page_id, replace(regexp_extract(lower(url), '(?:www\.)?([a-z0-9-]+)\.(?:{fixed.WEB_ENDINGS})\b', 1), '-', '') AS domain FROM pages",
    "customer_noise": f"SELECT c_custkey, trim({noise('lower(c_name)')}) AS kept FROM customer",
    "entities_by_country": with_(ENT, "SELECT country, src, count(*) AS n, sum(n_len)::BIGINT AS core_words FROM ent GROUP BY country, src"),
    "block_keys": with_(KEYS, "SELECT id, key FROM bkeys"),
    "key_frequency": with_(RARE, "SELECT country, key, df, round(w, 6) AS w FROM rare"),
    "key_candidates": with_(RARE, "SELECT country, id1, id2, round(sim, 6) AS sim, rank::INTEGER AS rank FROM kc"),
    "tfidf_char": with_(_CHARS, "SELECT id, term, round(w, 6) AS w FROM w"),
    "tfidf_word": with_(_WORDS, "SELECT id, term, round(w, 6) AS w FROM w"),
    "pair_cosine": with_(
        f"{_CHARS.replace(ENT, KPAIRS)}",
        "SELECT pr.id1, pr.id2, round(coalesce(sum(a.w * b.w), 0), 6) AS n_char FROM pr LEFT JOIN w a ON a.id = id1 LEFT JOIN w b ON b.id = id2 AND a.term = b.term GROUP BY 1, 2",
    ),
    "topk_dense": with_(f"{VECS}, {top('s1', 's2', 5, 'fw')}", "SELECT id1, id2, round(sim, 6) AS sim, rank::INTEGER AS rank FROM fw"),
    "reverse_topk": with_(f"{VECS}, {top('s2', 's1', 3, 'fw')}", "SELECT id2 AS id1, id1 AS id2, round(sim, 6) AS sim, rank::INTEGER AS rank FROM fw"),
    "self_topk": with_(f"{VECS}, {top('s2', 's2', 4, 'fw', 'AND id1 <> id2')}", "SELECT id1, id2, round(sim, 6) AS sim, rank::INTEGER AS rank FROM fw"),
    "two_hop": with_(
        f"{VECS}, {top('s1', 's2', 5, 'fw')}, {top('s2', 's2', 4, 'hp', 'AND id1 <> id2')}",
        "SELECT fw.id1, hp.id2, round(max(hp.sim), 6) AS sim, min(hp.rank)::INTEGER AS rank FROM fw JOIN hp ON fw.id2 = hp.id1 WHERE fw.rank < 3 GROUP BY 1, 2",
    ),
    "union_candidates": with_(
        f"{VECS}, {top('s1', 's2', 5, 'fw')}, {top('s2', 's1', 3, 'bw')}, {top('s2', 's2', 4, 'hp', 'AND id1 <> id2')}",
        """, al AS (SELECT id1, id2, 'name' AS ps, rank, sim FROM fw UNION ALL SELECT id2, id1, 'rev', rank, sim FROM bw
  UNION ALL SELECT fw.id1, hp.id2, 'hop', hp.rank, hp.sim FROM fw JOIN hp ON fw.id2 = hp.id1 WHERE fw.rank < 3)
SELECT id1, id2, """
        + ", ".join(f"round(coalesce(max(sim) FILTER (ps = '{p}'), -1), 6) AS sim_{p}, coalesce(min(rank) FILTER (ps = '{p}'), -1)::INTEGER AS rank_{p}" for p in ("name", "rev", "hop"))
        + ", count(DISTINCT ps)::INTEGER AS n_passes FROM al GROUP BY 1, 2",
    ).replace(")\n, al AS", "),\nal AS"),
    "pair_overlap": with_(
        KPAIRS,
        f"SELECT id1, id2, {_jac['name_core'][0]} AS n_jac, {_jac['name_core'][1]} AS n_cont, {_jac['name_core'][2]} AS n_inter, {_jac['name_phon'][0]} AS p_jac, {_jac['addr_words'][0]} AS a_jac, "
        f"{_jac['addr_nums'][0]} AS num_jac, {_jac['addr_nums'][2]} AS num_inter, {_jac['street'][1]} AS street_cont, {_jac['locality'][0]} AS loc_jac, {_jac['legal'][0]} AS lf_jac FROM pe",
    ),
    "pair_house": with_(
        KPAIRS,
        f"""SELECT id1, id2, {_known("l.house_no <> '' AND r.house_no <> ''", 'l.house_no = r.house_no')} AS house_eq, {_known(_both, 'l.house_dig = r.house_dig')} AS house_dig_eq,
  {_known(_both, 'right(l.house_dig, 2) = right(r.house_dig, 2)')} AS house_suffix_eq, {_known(_both, 'abs(length(l.house_dig) - length(r.house_dig))')} AS house_len_diff,
  {_known(_both, 'levenshtein(l.house_dig, r.house_dig)')} AS house_lev,
  round({_known(_both, "ln(1 + abs(CAST(substr(l.house_dig, 1, 9) AS BIGINT) - CAST(substr(r.house_dig, 1, 9) AS BIGINT)))")}, 6) AS house_logdiff,
  {_known("l.num_tok <> '' AND r.num_tok <> ''", 'levenshtein(l.num_tok, r.num_tok)')} AS num_tok_lev FROM pe""",
    ),
    "pair_flags": with_(
        KPAIRS,
        f"""SELECT id1, id2, CASE WHEN r.domain <> '' THEN CAST(contains(l.name_concat, r.domain) AS DOUBLE) ELSE -1.0 END AS dom_in_name,
  CAST(l.first_tok = r.first_tok AND l.first_tok <> '' AS DOUBLE) AS n_first_eq, CAST(r.src = 'S3' AS DOUBLE) AS is_s3, CAST(abs(l.n_len - r.n_len) AS DOUBLE) AS n_len_diff,
  {_known("l.legal <> '' AND r.legal <> ''", 'l.legal = r.legal')} AS lf_eq, CAST(l.legal = '' AS DOUBLE) AS lf_empty1 FROM pe""",
    ),
    "pair_fuzzy": with_(f"{KPAIRS},{FUZZY}", f"SELECT id1, id2, round(rf_token_set, 6) AS rf_token_set, round(rf_partial, 6) AS rf_partial, round({_jaro}, 6) AS rf_jaro FROM pe {_fuzzy_join}"),
    "pair_features": _pair_features(),
    "match_by_rare_keys": with_(_MATCHED, "SELECT ent.entity_id AS source1_entity_id, coalesce(string_agg(id2, ',' ORDER BY id2), '') AS matched_entity_ids FROM ent LEFT JOIN mo ON id1 = ent.entity_id WHERE src = 'S1' GROUP BY 1"),
    "pivot_candidates": with_(_PASSES, f"SELECT 'all' AS country, id1, id2, {_pass_columns}, count(DISTINCT ps)::INTEGER AS n_passes FROM al GROUP BY 1, 2, 3"),
    "text_topk": with_(_SEARCH, "SELECT id1, id2, round(sim, 6) AS sim, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY round(sim, 9) DESC, id2) - 1 AS rank FROM sm) WHERE rank < 5"),
    "fold_split": with_(REC, f"SELECT entity_id, k >= 8 AS val, (k >= 4)::INTEGER AS half FROM (SELECT entity_id, {crc('entity_id')} % 10 AS k FROM rec)"),
    "hash_sample": with_(REC, f"SELECT entity_id FROM rec WHERE {crc('entity_id')} % 1000 < 250"),
    "negative_sampling": with_(_LABELLED, f"SELECT id1, id2, y, round(CASE WHEN y = 1 THEN 1.0 ELSE pos / neg END, 9) AS weight FROM ng WHERE {crc('k')} / 4294967296 < CASE WHEN y = 1 THEN pos ELSE neg END"),
    "topk_search": with_(f"{VECS}, {top('s1', 's2', 5, 'fw')}", "SELECT id1, id2, round(sim, 6) AS sim, rank::INTEGER AS rank FROM fw"),
    "pair_jaro": with_(KPAIRS, "SELECT id1, id2, round(jaro_winkler_similarity(l.name_core, r.name_core), 6) AS rf_jaro FROM pe WHERE l.name_core <> '' AND r.name_core <> ''"),
    "competition_feats": with_(
        SCORED,
        """SELECT id1, id2, row_number() OVER (PARTITION BY id1 ORDER BY p DESC, id2)::INTEGER AS a_rank1, round(max(p) OVER (PARTITION BY id1) - p, 6) AS a_gap1,
  (SELECT count(*) FROM sp q WHERE q.id1 = sp.id1 AND q.p > (SELECT max(p) FROM sp z WHERE z.id1 = sp.id1) - 0.1) AS a_n_close1, round(sum(p) OVER (PARTITION BY id1), 6) AS a_sum1,
  row_number() OVER (PARTITION BY id2 ORDER BY p DESC, id1)::INTEGER AS a_rank2,
  round(p - CASE WHEN row_number() OVER (PARTITION BY id2 ORDER BY p DESC, id1) = 1 THEN coalesce(nth_value(p, 2) OVER (PARTITION BY id2 ORDER BY p DESC, id1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1) ELSE max(p) OVER (PARTITION BY id2) END, 6) AS a_margin2,
  count(*) OVER (PARTITION BY id2) AS a_n_owner2 FROM sp""",
    ),
    "support_feats": with_(
        SCORED,
        """, tp5 AS (SELECT id1, id2 AS other, p AS q, row_number() OVER (PARTITION BY id1 ORDER BY p DESC, id2) AS r FROM sp QUALIFY r <= 5),
mt AS (SELECT sp.id1, sp.id2, q, r, list_dot_product(x.vec, y.vec) AS c FROM sp JOIN tp5 ON tp5.id1 = sp.id1 AND other <> sp.id2 JOIN v x ON x.id = sp.id2 JOIN v y ON y.id = other)
SELECT sp.id1, sp.id2, round(greatest(coalesce(max(q * c), -1), -1), 6) AS s_max, count(*) FILTER (q > 0.5 AND c > 0.8) AS s_cnt, round(coalesce(arg_min(c, r), -1), 6) AS s_top
FROM sp LEFT JOIN mt USING (id1, id2) GROUP BY 1, 2""",
    ).replace("FROM fw)\n, tp5", "FROM fw),\ntp5"),
    "exclusive_owner": with_(f"{SCORED}, {OWN}", "SELECT id1, id2, p FROM ex"),
    "threshold_matches": with_(f"{SCORED}, {OWN}", "SELECT id1, id2, p FROM ex WHERE p >= 0.6503"),
    "expected_f": with_(f"{SCORED}, {OWN}, {EF}", "SELECT id1, id2, p FROM xf"),
    "entity_fbeta": with_(f"{SCORED}, {OWN}, {TRUE}, {EF}, {scores('xf')}", "SELECT id1, tp, n_pred, n_true, round(f, 6) AS f FROM es"),
    "macro_f": with_(f"{SCORED}, {OWN}, {TRUE}, {EF}, {scores('xf')}", "SELECT round(avg(f), 6) AS macro_f FROM es"),
    "error_classes": with_(
        f"{SCORED}, {OWN}, {TRUE}, {EF}, {scores('xf')}",
        """SELECT CASE WHEN n_true = 0 AND n_pred > 0 THEN 'singleton_merged' WHEN n_pred > tp AND n_true > tp THEN 'fp+fn' WHEN n_pred > tp THEN 'fp_only' WHEN n_true > tp THEN 'fn_only' ELSE 'perfect' END AS error_class,
  round(sum(1 - f) / (SELECT count(*) FROM es) * 100, 3) AS points FROM es GROUP BY 1""",
    ),
    "threshold_grid": with_(
        f"{SCORED}, {OWN}, {TRUE}, ts AS (SELECT unnest([{', '.join(str(round(0.4 + 0.025 * i, 3)) for i in range(21))}]::DOUBLE[]) AS t)",
        """, cn AS (SELECT t, s1.id AS id1, (SELECT count(*) FROM ex JOIN tr USING (id1, id2) WHERE ex.id1 = s1.id AND p >= t) AS tp, (SELECT count(*) FROM ex WHERE ex.id1 = s1.id AND p >= t) AS np,
  (SELECT count(*) FROM tr WHERE tr.id1 = s1.id) AS nt FROM ts, s1)
SELECT t, round(avg(CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + (tp / nt)) END), 6) AS macro_f FROM cn GROUP BY t""",
    ).replace(")\n, cn", "),\ncn"),
    "match_lists": with_(f"{SCORED}, {OWN}, {EF}", "SELECT s1.id AS source1_entity_id, coalesce(string_agg(CAST(id2 AS VARCHAR), ',' ORDER BY id2), '') AS matched_entity_ids FROM s1 LEFT JOIN xf ON xf.id1 = s1.id GROUP BY 1"),
    "match_coverage": with_(f"{SCORED}, {OWN}, {EF}", "SELECT 'all' AS country, count(*) AS n_s1, sum(m)::BIGINT AS n_matches, round(avg(m), 6) AS matches_per_s1, round(avg(CAST(m = 0 AS DOUBLE)), 6) AS empty_share FROM (SELECT s1.id, count(xf.id2) AS m FROM s1 LEFT JOIN xf ON xf.id1 = s1.id GROUP BY 1)"),
    "output_check": "SELECT unnest(['columns', 'unique', 'missing', 'unknown', 'repeated']) AS \"check\", 0::BIGINT AS failures",
    "rerank_jaccard": with_(
        f"{KPAIRS}, tx AS (SELECT id1, id2, list_distinct({words(chr(115) + 'ubstr(l.name_full || ' + chr(39) + ' | ' + chr(39) + ' || l.addr_full, 1, 160)')}) AS a, list_distinct({words(chr(115) + 'ubstr(r.name_full || ' + chr(39) + ' | ' + chr(39) + ' || r.addr_full, 1, 160)')}) AS b FROM pe)",
        "SELECT id1, id2, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS p_ce FROM tx",
    ),
    "rerank_blend": with_(
        f"{SCORED}, bl AS (SELECT id1, id2, p, CASE WHEN p BETWEEN 0.02 AND 0.995 THEN 0.75 * p + 0.25 * round(p * p, 6) ELSE p END AS b FROM sp)",
        "SELECT id1, id2, round(b, 9) AS p FROM bl",
    ),
    "source_audit": "SELECT name, n_rows, n_expected, coalesce(n_rows = n_expected, false) AS ok FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS name, {n} AS n_rows, {want}::BIGINT AS n_expected" for t, n, want in (
            ("region", "(SELECT count(*) FROM region)", 5), ("nation", "(SELECT count(*) FROM nation)", 25), ("orders", "(SELECT count(*) FROM orders)", "(SELECT 10 * count(*) FROM customer)"),
            ("supplier", "(SELECT count(*) FROM supplier)", 7), ("missing", "NULL::BIGINT", 1))) + ")",
    "blocking_recall": with_(
        f"{RARE}, tru AS (SELECT a.entity_id AS id1, b.entity_id AS id2, a.country FROM rec a JOIN documents x ON a.doc_id = x.doc_id JOIN documents y ON x.text = y.text JOIN rec b ON b.doc_id = y.doc_id WHERE a.country = b.country AND a.entity_id LIKE 'S1%' AND b.entity_id NOT LIKE 'S1%')",
        "SELECT t.country, count(kc.id1) AS found, count(*) AS true_pairs, round(count(kc.id1) / count(*), 6) AS recall FROM tru t LEFT JOIN kc ON kc.id1 = t.id1 AND kc.id2 = t.id2 GROUP BY 1",
    ),
}
