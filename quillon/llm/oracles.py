"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

from quillon.llm import mixing, quality, sharding, urlfilter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _decontaminate() -> str:
    words = rf"regexp_extract_all({_low('coalesce(text, chr(32))')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    i AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k,
             unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1),
               lambda p: array_to_string(w[p : p + least(10, len(w)) - 1], ' '))) AS x
           FROM i WHERE len(w) > 0),
    k AS (SELECT DISTINCT k FROM iw),
    dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p,
             unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p : p + k - 1], ' '))) AS x
           FROM d, k WHERE len(w) >= k),
    m AS (SELECT r, p, dw.k AS k, item_id FROM dw JOIN iw ON dw.x = iw.x AND dw.k = iw.k),
    hit AS (SELECT r, count(DISTINCT q) AS n_hit
            FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
    own AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)"""


def _urls() -> str:
    rules = urlfilter.UrlRules()
    terms = [f"('{t}', NULL)" for t in rules.strict]
    terms += [f"('{t}', CAST({w} AS DOUBLE))" for t, w in rules.soft.items() if t not in rules.strict]
    named = ", ".join(
        f"('{v}', '{n}', '{n.partition('/')[0]}', '/{n.partition('/')[2]}')" for v, n in rules.rules
    )
    rest = "substr(url, instr(url, '://') + 3)"
    return f"""
    WITH t(term, weight) AS (VALUES {', '.join(terms)}),
    u(verdict, rule, h, p) AS (VALUES {named}),
    s AS (SELECT row_number() OVER () AS r, page_id, url,
            CASE WHEN contains(url, '://') THEN regexp_extract({rest}, '^[^?#]*') ELSE '' END AS rest FROM pages),
    q AS (SELECT r, page_id, {_low('url')} AS low, {_low("regexp_extract(rest, '^[^/]*')")} AS host,
            regexp_extract(rest, '^[^/]*(/?.*)$', 1, 's') AS path FROM s),
    hit AS (SELECT r, count(*) FILTER (weight IS NULL) AS n_strict, count(weight) AS n_soft,
              coalesce(sum(weight), 0) AS soft_weight
            FROM q JOIN t ON contains(low, term)
             AND regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY r),
    best AS (SELECT r, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule
             FROM q JOIN u ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
    SELECT page_id, host, path, best.rule AS rule,
           coalesce(best.verdict, CASE WHEN coalesce(n_strict, 0) > 0
             OR (coalesce(n_soft, 0) >= {rules.least_distinct} AND coalesce(soft_weight, 0) >= {rules.threshold})
             THEN 'block' ELSE 'allow' END) AS verdict,
           CAST(coalesce(n_strict, 0) AS BIGINT) AS n_strict, CAST(coalesce(n_soft, 0) AS BIGINT) AS n_soft,
           CAST(coalesce(soft_weight, 0) AS DOUBLE) AS soft_weight
    FROM q LEFT JOIN hit USING (r) LEFT JOIN best USING (r)"""


#: Enough for the fit to settle on the given tables: the operator goes on until a round moves nothing.
MIXING_ROUNDS = 40


def mixing_ctes(table: str) -> tuple[str, str]:
    """CTEs that rake the cells of a table, and the condition that keeps a row of its keyed form."""
    rules = mixing.MixRules()
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mixing.TOPIC_RULES)
    parts = [f"""
    keyed AS (SELECT *, CASE {topic} ELSE 'prose' END AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
        CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{rules.seed}'), 1, 8) AS BIGINT) AS DOUBLE)
          / 4294967296.0 AS u FROM {table}),
    c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens,
        sum(tokens)::DOUBLE * {rules.budget} AS w FROM keyed GROUP BY ALL)"""]
    for a in mixing.AXES:
        parts.append(f"""s_{a} AS MATERIALIZED (SELECT {a}, x / sum(x) OVER () AS share FROM
          (SELECT {a}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {rules.power[a]}) ELSE 0 END AS x FROM c0 GROUP BY ALL))""")
    step = 0
    for _ in range(MIXING_ROUNDS):
        for a in mixing.AXES:
            parts.append(f"""c{step + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens,
              least(tokens, w * coalesce(share * {rules.budget} * (SELECT sum(tokens) FROM c0)
                / nullif(sum(w) OVER (PARTITION BY c.{a}), 0), 0)) AS w
              FROM c{step} c JOIN s_{a} s ON c.{a} IS NOT DISTINCT FROM s.{a})""")
            step += 1
    parts.append(
        f"fitted AS (SELECT source AS f1, lang AS f2, topic AS f3, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS p FROM c{step})"
    )
    return ",\n".join(parts), "source IS NOT DISTINCT FROM f1 AND lang IS NOT DISTINCT FROM f2 AND topic = f3"


def _mixing() -> str:
    ctes, same = mixing_ctes("documents")
    return f"""WITH {ctes}
    SELECT doc_id, source, lang, topic, tokens AS n_tokens, round(p, 6) AS p, u < p AS selected
    FROM keyed JOIN fitted ON {same}"""


def _sharding() -> str:
    n = sharding.SHARDS
    bits = "c"
    for _ in range(8):
        bits = f"list_transform({bits}, lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    table = bits.replace("(c,", "(range(0, 256),", 1)
    return f"""
    WITH t AS MATERIALIZED (SELECT {table} AS crc),
    b AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
            CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
              regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
              lambda c, v: xor(crc[CAST(xor(c, v) & 255 AS INT) + 1], c >> 8))) AS BIGINT) AS text_crc32
          FROM documents, t),
    k AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':42:' || text_crc32 || ':' || size) AS h FROM b),
    r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY source) AS place, count(*) OVER () AS n FROM k),
    p AS (SELECT *, row_number() OVER (ORDER BY place, coalesce(source, chr(0)), h, doc_id, text_crc32, size) - 1 AS pos FROM r),
    s AS (SELECT *, pos * {n} // n AS shard FROM p)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
           CAST(pos - (shard * n + {n - 1}) // {n} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source
    FROM s"""


def _quality() -> str:
    rules, vocab = quality.QualityRules(), quality.vocabulary()
    letters = "".join(chr(c) for c in range(0xA0, 0x250) if chr(c).isalpha())
    classes = ["[a-z]", "[A-Z]", "[0-9]", " ", r"[\x00-\x1F\x7F-\x{9F}]", """[.,;:!?''"()-]""", r"[#-&*+/<=>@\[-`{-~]", f"[{letters}]"]
    counts = [f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in classes]
    listed = ", ".join(f"'{w}'" for w in vocab)
    known = ", ".join(f"'{k}'" for k in quality.COMMON_WORDS)
    js = """sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z:
      CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2))"""
    windows = "list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: {})"
    blend = "list_transform(list_zip(a.{0}, b.{0}), lambda z: s * z[1] + (1 - s) * z[2])"
    shares = ", ".join(f"({s}::DOUBLE)" for s in quality.MIXTURES)
    return f"""
    WITH a AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    tri AS (SELECT r, unnest({windows.format('i')}) AS i, unnest({windows.format('(w[i], w[i + 1], w[i + 2])')}) AS x FROM a),
    again AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS q FROM
        (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM tri) WHERE c > 1) GROUP BY r),
    lines AS (SELECT r, count(*) - count(DISTINCT s) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS s FROM a)
        WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    wc AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM a) WHERE word IN ({listed}) GROUP BY ALL),
    wl AS (SELECT r, map_from_entries(list((word, n))) AS m, sum(n) AS hits FROM wc GROUP BY r),
    b AS (SELECT a.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(text) AS n_chars,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
        [{', '.join(counts)}] AS cc,
        list_append(list_transform([{listed}], lambda x: coalesce(m[x], 0)), len(w) - coalesce(hits, 0)) AS ww
      FROM a LEFT JOIN again USING (r) LEFT JOIN lines USING (r) LEFT JOIN wl USING (r)),
    d AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
        n_words >= {rules.guard_words} AND n_chars >= {rules.guard_chars} AS long_enough,
        list_transform(list_append(cc, n_chars - list_sum(cc)), lambda x: x / CAST(n_chars AS DOUBLE)) AS p,
        list_transform(ww, lambda x: x / CAST(n_words AS DOUBLE)) AS q FROM b),
    langs AS (SELECT coalesce(lang, '') AS lang FROM d WHERE long_enough GROUP BY 1
        QUALIFY row_number() OVER (ORDER BY count(*) DESC, coalesce(lang, '')) <= {rules.max_languages} AND count(*) >= {rules.min_documents}),
    units AS (SELECT CASE WHEN lang IN ({known}) OR lang IN (SELECT lang FROM langs) THEN lang ELSE '' END AS lang,
        unnest(range(0, len(p) + len(q))) AS bin, unnest(list_transform(list_concat(p, q), lambda x: round_even(x * {quality.UNIT}, 0))) AS u
      FROM d WHERE long_enough),
    ref AS (SELECT lang, list(t ORDER BY bin) AS t FROM (SELECT lang, bin, sum(u) AS t FROM units GROUP BY ALL) GROUP BY lang),
    refs AS (SELECT lang, list_transform(t[1:9], lambda x: x / list_sum(t[1:9])) AS rp, list_transform(t[10:], lambda x: x / list_sum(t[10:])) AS rq FROM ref),
    mixed AS (SELECT rp, rq FROM refs UNION ALL SELECT {blend.format('rp')}, {blend.format('rq')}
      FROM refs a JOIN refs b ON a.lang < b.lang AND a.lang IN ({known}) AND b.lang IN ({known}), (VALUES {shares}) m(s)),
    dist AS (SELECT r, {js.format(p='p', q='rp')} AS c, {js.format(p='q', q='rq')} AS v FROM d, mixed WHERE long_enough),
    near AS (SELECT r, arg_min(c, c + v) AS c, arg_min(v, c + v) AS v FROM dist GROUP BY r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND coalesce(c <= {rules.max_char_distance} AND v <= {rules.max_word_distance} + {rules.word_distance_noise}::DOUBLE / sqrt(n_words), true) AS kept,
      round(c, 6) AS js_char, round(v, 6) AS js_word
    FROM d LEFT JOIN near USING (r)"""


def _interaction() -> str:
    return r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    m AS (SELECT doc_id, part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
            + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS INT)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
            + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d),
    l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
          FROM labels GROUP BY doc_id),
    h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
          FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM f a, f b, f c, f e, f g
          WHERE length(a.x || b.x || c.x || e.x || g.x) = len(list_distinct([a.x, b.x, c.x, e.x, g.x]))),
    s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
            coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0) AS before
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, own,
            sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM h, s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
      CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
      CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_divergence": _quality(),
        "op2_decontaminate": _decontaminate(),
        "op3_url_filter": _urls(),
        "op4_mixing": _mixing(),
        "op10_sharding": _sharding(),
        "op12_filter_interaction": _interaction(),
    }
