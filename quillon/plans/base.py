"""The query register, and the DuckDB forms of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from quillon.functions.seeds import MIX
from quillon.operators.resample import N_BOOT, POISSON

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return NORM.format(x=x)


def dot(a: str, b: str) -> str:
    return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def draw(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}' || {' || '.join(f''' ':' || {p}''' for p in parts)}), 1, 8) AS BIGINT)"


def mixed(x: str, out: str) -> str:
    """Columns that end in ``out``: the number in column x through the steps of ``functions.seeds.mix32``."""
    first, second = MIX
    return (
        f"xor({x}, {x} >> 16) * {first}::UBIGINT & 4294967295::UBIGINT AS {out}1, "
        f"xor({out}1, {out}1 >> 15) * {second}::UBIGINT & 4294967295::UBIGINT AS {out}2, xor({out}2, {out}2 >> 16) AS {out}"
    )


def counters_sql(n: int, seed: int) -> str:
    return f"SELECT b, CAST(b + {seed * 1_000_003} AS UBIGINT) & 4294967295::UBIGINT AS x, {mixed('x', 'c')} FROM range({n}) r(b)"


def poisson_sql(source: str, n_boot: int, seed: int = 7) -> str:
    """CTEs of reps(g, b, m) over ``vals(g, k, x)``: the Poisson bootstrap of every group g, as ``operators.resample`` draws it."""
    weigh = lambda half: " + ".join(f"({half} >= {p})::INT" for p in POISSON)
    return f"""{source}, cnt AS MATERIALIZED ({counters_sql((n_boot + 1) // 2, seed)}),
  kept AS MATERIALIZED (SELECT g, x::DOUBLE AS v, CAST('0x' || substr(md5(k), 1, 8) AS UBIGINT) AS k1, CAST('0x' || substr(md5(k), 9, 8) AS UBIGINT) AS k2 FROM vals WHERE x IS NOT NULL),
  drawn AS (SELECT g, v, b, xor(k1, c) AS y, {mixed('y', 'h')}, h + k2 & 4294967295::UBIGINT AS z, {mixed('z', 'u')}, u & 65535 AS lo_, u >> 16 AS hi_, {weigh('lo_')} AS w0, {weigh('hi_')} AS w1 FROM kept, cnt),
  halves AS (SELECT g, b, sum(w0 * v) AS s0, sum(w0) AS n0, sum(w1 * v) AS s1, sum(w1) AS n1 FROM drawn GROUP BY g, b),
  reps AS (SELECT g, 2 * b AS b, s0 / nullif(n0, 0) AS m FROM halves UNION ALL SELECT g, 2 * b + 1, s1 / nullif(n1, 0) FROM halves WHERE 2 * b + 1 < {n_boot})"""


def indexed_sql(source: str, n_boot: int, seed: int = 7) -> str:
    """CTEs n, idx(i, x), reps(b, m) of ``vals(k, x)``: rows drawn with replacement in the order of k."""
    return f"""{source}, idx AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS UBIGINT) AS i, x::DOUBLE AS x FROM vals WHERE x IS NOT NULL),
  n AS (SELECT count(*) AS n FROM idx), cnt AS MATERIALIZED (SELECT b, c, xor(c, 2654435769::UBIGINT) AS e, {mixed('e', 'o')} FROM ({counters_sql(n_boot, seed)})),
  drawn AS (SELECT b, xor(i, c) AS y, {mixed('y', 'h')}, h + o & 4294967295::UBIGINT AS z, {mixed('z', 'u')}, CAST(u % n AS UBIGINT) AS j FROM idx, cnt, n),
  reps AS (SELECT b, avg(idx.x) AS m FROM drawn JOIN idx ON j = idx.i GROUP BY b)"""


#: Interval and centred p-value of reps beside the observed mean difference of each group.
def paired_sql(group: str = "g") -> str:
    return f"""seen AS (SELECT g, avg(x)::DOUBLE AS mean_diff, count(x) AS n_pairs FROM vals GROUP BY g),
  mid AS (SELECT g, avg(m) AS centre, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps GROUP BY g),
  far AS (SELECT g, avg((round(m - centre, 12) >= round(abs(mean_diff), 12))::INT) AS up, avg((round(m - centre, 12) <= -round(abs(mean_diff), 12))::INT) AS down
    FROM reps JOIN mid USING (g) JOIN seen USING (g) GROUP BY g),
  tested AS (SELECT g AS {group}, mean_diff, lo, hi, least(2 * least(up, down), 1.0::DOUBLE) AS p_value, n_pairs FROM seen LEFT JOIN mid USING (g) LEFT JOIN far USING (g))"""


TRANSFORM_ROWS = "(VALUES (0,'clean'),(1,'resize'),(2,'jpeg'),(3,'crop'),(4,'rerender'),(5,'blur')) t(t_id, transform)"
VARIANT_ROWS = "(VALUES (0,'base'),(1,'attacked'),(2,'defended_attack'),(3,'defended_control')) v(v_id, variant)"


def records(name: str = "rec", multiplier: int = 31) -> str:
    return f"""{name} AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS category, variant, transform,
      CASE WHEN v_id IN (1, 2) THEN (['bottom_right', 'top_right', 'center'])[doc_id % 3 + 1] END AS attack_position,
      quality AS judged_correct,
      CASE WHEN (v_id = 2 AND (13 * doc_id + 5 * t_id) % 10 < 8) OR (v_id = 3 AND (13 * doc_id + 5 * t_id) % 10 < 1)
        THEN 1 ELSE 0 END AS firewall_flagged, CAST(NULL AS INT) AS matched_attack_target,
      CASE WHEN ({multiplier} * doc_id + 17 * t_id + 7 * v_id) % 10 < 2 + 4 * toxic - CASE WHEN v_id = 2 THEN 1 ELSE 0 END
        THEN 1 ELSE 0 END AS is_unsafe
      FROM labels JOIN documents USING (doc_id), {TRANSFORM_ROWS}, {VARIANT_ROWS} WHERE v_id <> 0 OR t_id = 0)"""


BANK = "bank AS (SELECT vec_id AS rid, embedding FROM embeddings WHERE vec_id < 30)"
SPANS = "spans AS (SELECT vec_id AS span_id, vec_id % 50 AS image_id, embedding, label FROM embeddings WHERE vec_id >= 30)"
IMAGES = "images AS (SELECT vec_id AS image_id, embedding FROM embeddings WHERE vec_id < 50)"
SCORED = f"scored AS (SELECT span_id, image_id, label, s.embedding, max({dot('s.embedding', 'b.embedding')}) AS s_inst FROM spans s, bank b GROUP BY ALL)"
RISK = f"""risk AS (SELECT span_id, scored.image_id, label, s_inst, greatest(-{dot('scored.embedding', 'i.embedding')}, -0.1::DOUBLE) AS s_inc,
  s_inst + 0.5::DOUBLE * greatest(-{dot('scored.embedding', 'i.embedding')}, -0.1::DOUBLE) AS risk
  FROM scored JOIN images i ON scored.image_id = i.image_id)"""
WITH_RISK = f"WITH {BANK}, {SPANS}, {IMAGES}, {SCORED}, {RISK}"
RESPONSES = "resp AS (SELECT conv_id, turn, text AS response, chr(CAST(65 + conv_id % 5 AS INT)) AS answer FROM conversations WHERE role = 'assistant')"
WORDS = """lin AS (SELECT doc_id AS image_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS value FROM documents),
part AS (SELECT image_id, line, unnest(range(0, len(string_split(value, ' ')))) AS spot, unnest(string_split(value, ' ')) AS text FROM lin),
pre AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY image_id, line ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM part),
inl AS (SELECT *, row_number() OVER (PARTITION BY image_id, line ORDER BY spot) - 1 AS in_line FROM pre WHERE text <> ''),
words AS (SELECT image_id, CAST(line * 1000000 + in_line AS BIGINT) AS ord, text, CAST(20 * line + 70 * (line // 3) AS INT) AS top,
  CAST(10 * prefix + 45 * (in_line // 5) AS INT) AS left_, CAST(10 * length(text) AS INT) AS width, 16 AS height FROM inl)"""
LINES = WORDS + """,
gap AS (SELECT *, lag(top) OVER w AS ptop, lag(left_) OVER w AS pleft, lag(width) OVER w AS pwidth, lag(height) OVER w AS pheight
  FROM words WINDOW w AS (PARTITION BY image_id ORDER BY top, left_, ord)),
lines AS (SELECT *, CAST(sum(CASE WHEN ptop IS NULL OR NOT (abs(top - ptop) < greatest(height, pheight) * 0.7::DOUBLE AND left_ - (pleft + pwidth) < 40) THEN 1 ELSE 0 END)
  OVER (PARTITION BY image_id ORDER BY top, left_, ord ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS line_id FROM gap)"""
BOXES = LINES + """,
boxes AS (SELECT image_id, line_id, min(left_) AS l, min(top) AS t, max(left_ + width) AS r, max(top + height) AS b, count(*) AS n_words FROM lines GROUP BY ALL)"""
REGIONS = BOXES + """,
folded AS (SELECT image_id, list(line_id ORDER BY line_id) AS ids, list_reduce(
    list(struct_pack(g := -1, l := l, r := r, b := b, t := t, out := CAST([] AS INT[])) ORDER BY line_id),
    lambda s, x: CASE WHEN s.g >= 0 AND x.t - s.b < 60 AND NOT (x.r < s.l OR x.l > s.r)
      THEN struct_pack(g := s.g, l := least(s.l, x.l), r := greatest(s.r, x.r), b := greatest(s.b, x.b), t := s.t, out := list_append(s.out, s.g))
      ELSE struct_pack(g := s.g + 1, l := x.l, r := x.r, b := x.b, t := s.t, out := list_append(s.out, s.g + 1)) END,
    struct_pack(g := -1, l := 0, r := 0, b := 0, t := 0, out := CAST([] AS INT[]))).out AS regs FROM boxes GROUP BY image_id),
regions AS (SELECT image_id, unnest(ids) AS line_id, unnest(regs) AS region_id FROM folded)"""
WINDOWS = """ordered AS (SELECT image_id, span_id, embedding, row_number() OVER (PARTITION BY image_id ORDER BY span_id) - 1 AS first FROM spans),
win AS (SELECT a.image_id, a.first, z.size, list(b.span_id ORDER BY b.first) AS members, list(b.embedding ORDER BY b.first) AS vs
  FROM ordered a, (VALUES (1), (2), (3)) z(size), ordered b
  WHERE a.image_id = b.image_id AND b.first >= a.first AND b.first < a.first + z.size
  GROUP BY ALL HAVING count(*) = z.size),
cand AS (SELECT image_id, CAST(first AS INT) AS first, size, members, CAST(row_number() OVER (PARTITION BY image_id ORDER BY size, first) - 1 AS INT) AS cand_idx, vs FROM win)"""
CANDIDATE_SCORES = f"""summed AS (SELECT *, list_transform(range(1, 65), lambda i: list_reduce(list_transform(vs, lambda v: CAST(v[i] AS DOUBLE)), lambda x, y: x + y)) AS total FROM cand),
unit AS (SELECT * EXCLUDE (total, vs), list_transform(total, lambda x: x / sqrt(list_inner_product(total, total))) AS embedding FROM summed),
cs AS (SELECT u.image_id, cand_idx, size, members, u.embedding, max({dot('u.embedding', 'b.embedding')}) AS s_inst FROM unit u, bank b GROUP BY ALL),
cr AS (SELECT cs.image_id, cand_idx, size, members, s_inst, s_inst + 0.5::DOUBLE * greatest(-{dot('cs.embedding', 'i.embedding')}, -0.1::DOUBLE) AS score
  FROM cs JOIN images i ON cs.image_id = i.image_id)"""
WITH_CANDIDATES = f"WITH {BANK}, {SPANS}, {IMAGES}, {WINDOWS}, {CANDIDATE_SCORES}"
