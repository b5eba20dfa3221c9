"""SQL of queries whose check takes more than a line or two."""

from __future__ import annotations

from ..functions import draws as R
from ..operators import assembly, evaluation, generation, segments

_SIGNS = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _bleu_words(x: str) -> str:
    x = f"replace(replace(replace(coalesce({x}, ''), '<skipped>', ''), '-\n', ''), '\n', ' ')"
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{sign}')"
    x = f"' ' || {x} || ' '"
    for p, to in ((r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def _chrf_words(x: str) -> str:
    split = f"""CASE WHEN length(w) = 1 THEN [w] WHEN regexp_matches(right(w, 1), '{_SIGNS}') THEN [left(w, -1), right(w, 1)]
      WHEN regexp_matches(left(w, 1), '{_SIGNS}') THEN [left(w, 1), substr(w, 2)] ELSE [w] END"""
    return f"flatten(list_transform(list_filter(string_split_regex(coalesce({x}, ''), '\\s+'), lambda w: w <> ''), lambda w: {split}))"


def scores(rows: str, by: str) -> str:
    """CTEs up to ``scored`` (id, bleu, chrf) over a CTE ``rows`` (id, hyp, ref); counts are summed by the expression ``by``."""
    kinds = (("b", evaluation.BLEU_ORDER, _bleu_words), ("c", evaluation.CHAR_ORDER, lambda x: f"string_split(regexp_replace(coalesce({x}, ''), '\\s', '', 'g'), '')"), ("w", evaluation.WORD_ORDER, _chrf_words))
    cut = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, {top} AS top, list_filter({f('hyp')}, lambda x: x <> '') AS h, list_filter({f('ref')}, lambda x: x <> '') AS r FROM {rows}" for k, top, f in kinds)
    most = max(top for _, top, _ in kinds)
    leads = ", ".join(f"lead(tok, {k}) OVER w AS a{k}" for k in range(1, most))
    upto = " ".join(f"WHEN {n} THEN {" || ' ' || ".join(['tok', *(f'a{k}' for k in range(1, n))])}" for n in range(1, most + 1))
    gram = lambda c: f"""SELECT id, kind, n, g, count(*) AS k FROM (SELECT id, kind, n, CASE n {upto} END AS g FROM
  (SELECT *, {leads} FROM (SELECT id, kind, top, unnest({c}) AS tok, generate_subscripts({c}, 1) AS pos FROM cut) WINDOW w AS (PARTITION BY id, kind ORDER BY pos)),
  (SELECT unnest(range(1, {most + 1})) AS n) WHERE n <= top) WHERE g IS NOT NULL GROUP BY ALL"""  # noqa: E731
    return f"""cut AS MATERIALIZED ({cut}), orders AS (SELECT id, kind, len(h) AS h, len(r) AS r, unnest(range(1, top + 1)) AS n FROM cut), gh AS ({gram("h")}), gr AS ({gram("r")}),
met AS (SELECT id, kind, n, sum(least(gh.k, gr.k)) AS m FROM gh JOIN gr USING (id, kind, n, g) GROUP BY ALL),
counted AS (SELECT {by} AS id, kind, n, sum(greatest(0, h - n + 1)) AS h, sum(greatest(0, r - n + 1)) AS r, sum(coalesce(m, 0)) AS m
  FROM orders LEFT JOIN met USING (id, kind, n) GROUP BY ALL),
zeros AS (SELECT *, sum((m = 0 AND h > 0)::INT) OVER (PARTITION BY id ORDER BY n) AS z FROM counted WHERE kind = 'b'),
bleus AS (SELECT id, CASE WHEN min(h) = 0 OR sum(m) = 0 THEN 0.0 ELSE 100.0 * exp(sum(ln(CASE WHEN m = 0 THEN 1.0 / (2.0 ** z * h) ELSE m / h END)) / {evaluation.BLEU_ORDER})
  * CASE WHEN max(h) FILTER (n = 1) < max(r) FILTER (n = 1) THEN exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1)) ELSE 1.0 END END AS bleu FROM zeros GROUP BY id),
means AS (SELECT id, avg(m / h) FILTER (h > 0 AND r > 0) AS p, avg(m / r) FILTER (h > 0 AND r > 0) AS q FROM counted WHERE kind <> 'b' GROUP BY id),
scored AS (SELECT id, bleu, coalesce(100.0 * 5 * p * q / nullif(4 * p + q, 0), 0) AS chrf FROM bleus JOIN means USING (id))"""


def windows(lines: str, copies: int | str, seed: int, max_bytes: int) -> str:
    """CTEs up to ``merged`` (id, copy, win, n_lines, t, tr) over a CTE ``lines`` (id, ts, trs: lists of one segment)."""
    weight = "CASE x " + " ".join(f"WHEN {k} THEN {w}" for k, w in segments.WINDOW_WEIGHTS.items()) + " END"
    sizes = list(segments.WINDOW_WEIGHTS)
    span = lambda c: f"array_to_string({c}[i + 1 : i + x], ' ')"
    return f"""copies AS (SELECT *, unnest(range(0, {copies})) AS copy FROM {lines}), places AS (SELECT *, unnest(range(0, len(ts))) AS i FROM copies),
fits AS (SELECT *, list_filter({sizes}, lambda x: i + x <= len(ts) AND strlen({span("ts")}) <= {max_bytes} AND strlen({span("trs")}) <= {max_bytes}) AS able FROM places),
drawn AS (SELECT *, {R.sql_uniform(seed, "id", "0", "copy", "i")} * coalesce(list_sum(list_transform(able, lambda x: {weight})), 0) AS u FROM fits),
picked AS (SELECT *, coalesce(list_filter(able, lambda y: u < list_sum(list_transform(list_filter(able, lambda z: z <= y), lambda x: {weight})))[1], 1) AS n_lines FROM drawn),
chain AS (SELECT id, copy, 0::BIGINT AS i, 0::BIGINT AS win FROM copies WHERE len(ts) > 0
  UNION ALL SELECT c.id, c.copy, c.i + p.n_lines, c.win + 1 FROM chain c JOIN picked p ON c.id = p.id AND c.copy = p.copy AND c.i = p.i WHERE c.i + p.n_lines < len(p.ts)),
merged AS (SELECT p.id, p.copy, c.win::INT AS win, n_lines::INT AS n_lines, array_to_string(ts[p.i + 1 : p.i + n_lines], ' ') AS t, array_to_string(trs[p.i + 1 : p.i + n_lines], ' ') AS tr
  FROM chain c JOIN picked p ON c.id = p.id AND c.copy = p.copy AND c.i = p.i)"""


def stratified(targets: str, stratum: str, document: str, key: str, table: str, seed: int, per_document: int = 2) -> str:
    order = f"{R.sql_order_key(seed, key)}, {key}"
    return f"""WITH goal AS ({targets}), d AS (SELECT *, row_number() OVER (PARTITION BY {stratum}, {document} ORDER BY {order}) AS in_document FROM {table}),
k AS (SELECT d.*, target, available, sum((in_document <= {per_document})::INT) OVER (PARTITION BY d.{stratum}) AS diverse FROM d JOIN goal ON goal.{stratum} = d.{stratum})
SELECT {stratum}, {key} FROM k WHERE in_document <= {per_document} OR diverse < target OR target >= available
QUALIFY row_number() OVER (PARTITION BY {stratum} ORDER BY {order}) <= target"""


def weighted(table: str, key: str, weight: str, n: int, seed: int, ranges: int) -> str:
    return f"""WITH r AS (SELECT {key}, {weight} AS w, floor({R.sql_uniform(f"{seed}range", key)} * {ranges})::INT AS r FROM {table}),
s AS (SELECT r, sum(w) AS w FROM r GROUP BY r), b AS (SELECT r, sum(w) OVER (ORDER BY r) - w AS a, sum(w) OVER (ORDER BY r) AS b, sum(w) OVER () AS z FROM s),
i AS (SELECT {key}, r, w, sum(w) OVER (PARTITION BY r ORDER BY {key}) AS upto FROM r),
u AS (SELECT range AS draw, {R.sql_uniform(seed, "range")} * (SELECT max(z) FROM b) AS u FROM range(0, {n}))
SELECT draw, {key} FROM u JOIN b ON u >= b.a AND u < b.b JOIN i ON i.r = b.r AND u - b.a >= upto - w AND u - b.a < upto"""


def amounts(draws: str, seed: int) -> str:
    """draw, commodity, t, tr over a CTE ``draws`` (draw, commodity)."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    units = "(VALUES " + ", ".join("(" + ", ".join(map(lit, u)) + ")" for u in generation.UNITS) + ") AS u(commodity, c_t, c_tr, u_t, u_tr, low, high, sub)"
    quals = "(VALUES " + ", ".join(f"({lit(c)}, {k + 1}, {lit(a)}, {lit(b)})" for c, opts in generation.QUALIFIERS.items() for k, (a, b) in enumerate(opts)) + ") AS q(commodity, k, t, tr)"
    n_q = "CASE commodity " + " ".join(f"WHEN '{c}' THEN {len(o) + 1}" for c, o in generation.QUALIFIERS.items()) + " ELSE 0 END"
    whole = lambda n, tag: f"floor({R.sql_uniform(f'{seed}{tag}', 'draw')} * ({n}))::INT"
    signs = "[" + ", ".join(f"'{s}'" for s in generation.SIGNS) + "]"
    sign = lambda tag: f"CASE WHEN {R.sql_uniform(f'{seed}{tag}has', 'draw')} < {generation.FRACTION_SHARE} THEN {signs}[{whole(len(generation.SIGNS), f'{tag}sign')} + 1] END"
    single = lambda c, one: f"CASE WHEN {one} THEN CASE {c} " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in generation.SINGULAR.items()) + f" ELSE {c} END ELSE {c} END"
    return f"""listed AS (SELECT commodity, c_t, c_tr, list(struct_pack(low := low, high := high, u_t := u_t, u_tr := u_tr, sub := sub) ORDER BY low, high, u_t, u_tr, sub) AS units FROM {units} GROUP BY ALL),
chosen AS (SELECT d.draw, d.commodity, c_t, c_tr, units, units[{whole("len(units)", "unit")} + 1] AS u FROM {draws} d JOIN listed USING (commodity)),
second AS (SELECT *, list_filter(units, lambda x: x.u_t = u.sub)[1] AS s FROM chosen),
two AS (SELECT *, s IS NOT NULL AND {R.sql_uniform(f"{seed}two", "draw")} < {generation.COMPOUND_SHARE} AS two FROM second),
numbers AS (SELECT *, u.low + {whole("greatest(CASE WHEN two THEN greatest(u.high // 2, 1) ELSE u.high END - u.low + 1, 1)", "main")} AS n, {sign("main")} AS f,
  1 + {whole("greatest(least(s.high, 59), 1)", "sub")} AS m, {sign("sub")} AS g, CASE WHEN {n_q} > 0 THEN {whole(n_q, "qual")} ELSE 0 END AS k FROM two)
SELECT draw, v.commodity, concat_ws(' ', n, f, nullif(u.u_t, ''), CASE WHEN two THEN concat_ws(' ', m, g, nullif(s.u_t, '')) END, nullif(c_t, ''), q.t) AS t,
  concat_ws(' ', n, f, nullif({single("u.u_tr", "n = 1 AND f IS NULL")}, ''), CASE WHEN two THEN concat_ws(' ', m, g, nullif({single("s.u_tr", "m = 1 AND g IS NULL")}, '')) END, 'of ' || concat_ws(' ', q.tr, c_tr)) AS tr
FROM numbers v LEFT JOIN {quals} ON q.commodity = v.commodity AND q.k = v.k"""


def copies_of(source: str) -> str:
    return f"CASE {source} " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in assembly.COPIES.items()) + " ELSE 0 END"


def assembled(pairs: str, seed: int, max_bytes: int) -> str:
    """CTEs up to ``unique_`` (source, doc, n_lines, t, tr) over a CTE ``raw`` (source, priority, id, pos, t, tr, quality)."""
    return f"""q AS (SELECT *, source || '/' || id AS doc, sum((lower(coalesce(quality, '')) = 'low')::INT) OVER (PARTITION BY source, id ORDER BY pos) AS g FROM {pairs}),
s AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY g) - 1 AS segment FROM q WHERE lower(coalesce(quality, '')) <> 'low' AND trim(t) <> '' AND trim(tr) <> ''),
u AS (SELECT *, doc || '#' || segment AS k FROM s WHERE NOT regexp_matches(t, '(\\.\\.\\. ){{4,}}') AND NOT regexp_matches(tr, '(\\.\\.\\. ){{4,}}')),
lines AS (SELECT k AS id, source, list(t ORDER BY pos) AS ts, list(tr ORDER BY pos) AS trs FROM u GROUP BY ALL), {windows("lines", copies_of("source"), seed, max_bytes)},
every AS (SELECT source, priority, id, t, tr, 1 AS n_lines, 0 AS w, k, 0 AS copy, pos AS at_ FROM u UNION ALL
  SELECT d.source, d.priority, d.id, m.t, m.tr, m.n_lines, 1, m.id, m.copy, m.win FROM merged m JOIN (SELECT DISTINCT source, priority, id, k FROM u) d ON d.k = m.id),
unique_ AS (SELECT * FROM every WHERE trim(t) <> '' AND trim(tr) <> '' QUALIFY row_number() OVER (PARTITION BY lower(t), lower(tr) ORDER BY priority, w, k, copy, at_) = 1)"""
