"""Personal data: generators, boosted trees and calibrated thresholds, all in Spark SQL.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers; their valid matches are always kept.  Looser generators propose more
spans, which may overlap each other and the base matches: obfuscated addresses,
IPv6, single numbers within runs of digits, cards with other separators, phones
that a base match swallowed together with what follows, national phone formats.

Every candidate gets binary features of its format and of the text around it.
The rules that make a base match valid (checksum, number of digits, size of
octets) are no features: generated spans must pass them first, and the trees
judge what they cannot tell.  Trees of depth two are boosted for each kind on
the corpus' own base matches and on variants of them whose label follows from
how they were made:

* valid matches are personal data, as are their other spellings (obfuscated,
  national, regrouped), and with a word that announces them;
* matches of another kind, variants that run into a letter or a digit, that
  follow a word for another sort of number, or that have no known top-level
  domain are not;
* one number in ten passes the checksum by chance, so for nine that fail it, one
  valid number of the same features counts as none.

Spark sums the labelled spans of all documents by feature pattern, so fitting
sees at most 4 * 2^13 * 6 rows.  Trees are fitted on documents whose crc32(doc_id)
is not 0 modulo 4; the others, held out, give each kind's threshold: the
lowest score from which on the wanted precision holds.  Generated spans above it
are added where they touch no base span; those that overlap each other become
one span, of the kind of the first (of equal starts, the shortest).

Positions are code points, ends exclusive.  Pieces between matches (split) and
matches (regexp_extract_all) alternate, so their lengths add up to places.
Running sums go by blocks, so a text with very many matches takes time in
proportion to them, but for a small part.

Defined cases: a null text is empty and has no spans.  A corpus without base
matches, in or out of the held-out part, adds nothing for that kind.  An empty
table gives no rows.  Repeated rows give repeated rows, judged alike.  Long texts
are read whole.  Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import saved

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that each start is tried once: possessive, from the start of a run.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser generators (kind, pattern, a cheap test that a text must pass first).
LOOSE = (
    (EMAIL, rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(] ?(?:at|AT|@) ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]++)++",
     "text rlike '[\\\\[(] ?(?:at|AT|@) ?[\\\\])]'"),
    (IP, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "contains(text, ':')"),
    (CARD, r"(?<![0-9])[0-9]{12,19}(?![0-9])", "text rlike '[0-9]{12}'"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[ ._-]{1,3}[0-9]{4}){3}(?![0-9])", "text rlike '[0-9]{4}[ ._-]{1,3}[0-9]{4}'"),
    (PHONE, r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", "contains(text, '+')"),
    (PHONE, r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ]|00[0-9]{1,3}[ -])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
     "text rlike '[0-9]{3}[-. ][0-9]{4}'"),
)
_GUARD = {"email": "contains(text, '@')", "ip": "true", "card": "true", "phone": "contains(text, '+')"}

_DIGITS = "regexp_replace(c.t, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + "
    "if(i % 2 = 1, cast(substr(reverse({d}), i, 1) as int), "
    "2 * cast(substr(reverse({d}), i, 1) as int) - if(substr(reverse({d}), i, 1) > '4', 9, 0))) % 10 = 0"
)
#: Is a match (c.k, c.t) well formed?
_VALID = f"""case c.k
  when {EMAIL} then true
  when {IP} then contains(c.t, ':') or forall(split(c.t, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', right(ltrim('0', x), 3)) as int) <= 255)
  when {CARD} then length({_DIGITS}) between 12 and 19 and {_LUHN.format(d=_DIGITS)}
  else length({_DIGITS}) between 9 and 15 end"""
#: Words that announce a kind, and words that announce another sort of number.
_CUES = {
    EMAIL: "(?:e-?mail|mail|write to|reach|contact)",
    IP: "(?:address|host|server|from|ip|client|peer)",
    CARD: "(?:card|visa|credit|debit|account|payment|pan)",
    PHONE: "(?:phone|tel|call|fax|mobile|cell|contact|whatsapp|dial)",
}
_OTHER_CUES = "(?:part|item|order|model|serial|version|article|catalogue|invoice|ticket|isbn|sku|ref)"
#: Features of a candidate c (kind k, text t, text before b, character after n), one bit each.
FEATURES = (
    "c.b rlike '[A-Za-z0-9]$' or c.n rlike '[A-Za-z0-9]'",
    "startswith(c.t, '+')",
    "contains(c.t, '(') and c.t rlike '^[+0-9 ]*[(][0-9]'",
    "c.t rlike '(?<![0-9])[0-9]{3}[) .-]+[0-9]{3}[ .-]+[0-9]{4}$'",
    "c.t rlike '^[0-9]{12,}$' or c.t rlike '^[0-9]{4}([ ._-]{1,3}[0-9]{4}){3}$'",
    "c.t rlike '^[3-6]'",
    "c.t rlike '[\\\\[(] ?(?:at|AT|@) ?[\\\\])]'",
    "c.t rlike '(?i)(?:[.]|dot ?[\\\\])] ?)(?:com|org|net|edu|gov|info|io|co|[a-z]{2})$'",
    "contains(c.t, '@')",
    "case c.k " + " ".join(f"when {k} then c.b rlike '(?i){w}[^0-9]*$'" for k, w in _CUES.items()) + " end",
    f"c.b rlike '(?i){_OTHER_CUES}s?(?: (?:number|no|nr|code|id))?[.:#]* ?$'",
    "c.t rlike '^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$'",
    "c.t rlike '^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$'",
)
#: How a valid match of a kind is rewritten: (as kind, is it personal data, text, text before, character after).
_NATIONAL = "regexp_replace(c.t, '^[+][0-9]{1,3}[ .-]?', '')"
_DASHED = f"regexp_replace({_NATIONAL}, '^[(]([0-9]{{3}})[)] ?', '$1-')"
VARIANTS = {
    EMAIL: (
        (EMAIL, True, "replace(replace(c.t, '@', ' (at) '), '.', ' (dot) ')", "c.b", "c.n"),
        (EMAIL, True, "replace(c.t, '@', ' (at) ')", "c.b", "c.n"),
        (EMAIL, True, "replace(c.t, '@', ' [at] ')", "'mail to '", "' '"),
        (EMAIL, False, "regexp_replace(c.t, '^.*@([A-Za-z0-9-]+).*$', 'item (at) $1.page')", "c.b", "c.n"),
        (EMAIL, False, "regexp_replace(c.t, '^.*@([A-Za-z0-9-]+).*$', 'meet (at) $1.place')", "'mail '", "c.n"),
    ),
    IP: (
        (IP, True, "concat('2001:db8:85a3:0:', replace(c.t, '.', ':'))", "c.b", "c.n"),
        (IP, False, "concat('0a:1b:', replace(c.t, '.', ':'))", "c.b", "c.n"),
        (IP, False, "c.t", "'version '", "c.n"),
        (PHONE, False, "c.t", "c.b", "c.n"),
        (CARD, False, "c.t", "c.b", "c.n"),
    ),
    CARD: (
        (CARD, True, f"regexp_replace({_DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1.')", "c.b", "c.n"),
        (CARD, True, f"regexp_replace({_DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1  ')", "'card '", "c.n"),
        (CARD, False, "c.t", "concat(c.b, '7')", "c.n"),
        (CARD, False, "c.t", "c.b", "'x'"),
        (CARD, False, "c.t", "'serial number '", "c.n"),
        (PHONE, False, "c.t", "c.b", "c.n"),
    ),
    PHONE: (
        (PHONE, True, _NATIONAL, "c.b", "c.n"),
        (PHONE, True, _NATIONAL, "'phone: '", "c.n"),
        (PHONE, True, _DASHED, "'call '", "c.n"),
        (PHONE, False, _DASHED, "'part number '", "c.n"),
        (PHONE, False, _NATIONAL, "'order '", "c.n"),
        (PHONE, False, _NATIONAL, "c.b", "'7'"),
        (PHONE, False, "c.t", "concat(c.b, 'x')", "c.n"),
        (CARD, False, "c.t", "c.b", "c.n"),
    ),
}
#: Labels: no, yes, and a number that failed the checksum.
NO, YES, FAILED = range(3)
#: Numbers that pass the checksum by chance for each that fails it.
CHANCE = 1 / 9


@dataclass(frozen=True)
class PiiRules:
    rounds: int = 24
    learning_rate: float = 0.4
    precision: float = 0.95
    context_chars: int = 24
    #: Documents whose crc32(doc_id) has this remainder modulo the second are held out.
    held_out: tuple[int, int] = (0, 4)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """The body with the value, computed once, under a name."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, unused) -> {name}, {name} -> {body})"


def _running(values: str, op: str, start: int) -> str:
    """Running sums or maxima of an array of int.

    Spark copies the state of a fold at every step, so a fold whose state grows takes quadratic time.  Blocks of 64
    are folded one by one, from where the blocks before them end.
    """
    def both(a: str, b: str) -> str:
        return f"{a} + {b}" if op == "+" else f"greatest({a}, {b})"

    blocks = "if(size(rv) = 0, cast(array() as array<array<int>>), transform(sequence(0, (size(rv) - 1) div 64), i -> slice(rv, i * 64 + 1, 64)))"
    whole = f"aggregate(y, {start}, (p, q) -> {both('p', 'q')})"
    begins = f"aggregate(rb, array({start}), (a, y) -> concat(a, array({both('a[size(a) - 1]', whole)})))"
    within = f"slice(aggregate(y, array(rs[j]), (a, q) -> concat(a, array({both('a[size(a) - 1]', 'q')}))), 2, 64)"
    return _let("rv", values, _let("rb", blocks, _let("rs", begins, f"flatten(transform(rb, (y, j) -> {within}))")))


_FOUND = "struct<k:int,s:int,e:int,t:string,b:string,n:string>"
_PLACE = "struct<s:int,o:int,e:int,k:int>"
_LEAST = -(2**31) + 1


def _spans(name: str, kind: int, context: int) -> str:
    """Places of the matches m_<name> between the pieces p_<name>, with what stands around them."""
    parts = f"""transform(sequence(0, size(m_{name}) - 1), i -> named_struct('gap', length(p_{name}[i]), 'len', length(m_{name}[i]),
      't', m_{name}[i], 'b', right(p_{name}[i], {context}), 'n', left(p_{name}[i + 1], 1)))"""
    placed = f"transform(z, (x, i) -> named_struct('k', {kind}, 's', ends[i] - x.len, 'e', ends[i], 't', x.t, 'b', x.b, 'n', x.n))"
    ends = _running("transform(z, x -> x.gap + x.len)", "+", 0)
    return f"if(size(m_{name}) = 0, cast(array() as array<{_FOUND}>), {_let('z', parts, _let('ends', ends, placed))})"


def _untouched() -> str:
    """The loose spans that overlap no base span, sorted: none that began before them is open, none begins within them."""
    both = f"""array_sort(concat(
      transform(base, c -> named_struct('s', c.s, 'o', 0, 'e', c.e, 'k', c.k)),
      transform(loose, c -> named_struct('s', c.s, 'o', 1, 'e', c.e, 'k', c.k))))"""
    reach = _running(f"transform(u, x -> if(x.o = 0, x.e, {_LEAST}))", "max", _LEAST)
    ahead = _running(f"reverse(transform(u, x -> if(x.o = 0, -x.s, {_LEAST})))", "max", _LEAST)
    free = "filter(u, (x, i) -> x.o = 1 and x.s >= reach[i] and x.e <= -ahead[size(u) - 1 - i])"
    return f"if(size(loose) = 0, cast(array() as array<{_PLACE}>), {_let('u', both, _let('reach', reach, _let('ahead', ahead, free)))})"


def _merged() -> str:
    """Runs of overlapping loose spans as one span each, of the kind of the first."""
    heads = "filter(sequence(0, size(free) - 1), i -> i = 0 or free[i].s >= reach[i - 1])"
    one = "named_struct('s', free[i].s, 'k', free[i].k, 'e', if(j + 1 < size(heads), reach[heads[j + 1] - 1], reach[size(free) - 1]))"
    body = _let("reach", _running("transform(free, x -> x.e)", "max", 0), _let("heads", heads, f"transform(heads, (i, j) -> {one})"))
    return f"if(size(free) = 0, cast(array() as array<struct<s:int,k:int,e:int>>), {body})"


def _variants() -> str:
    """Labelled variants of a valid base match c."""
    cases = []
    for kind, made in VARIANTS.items():
        each = [
            f"named_struct('k', {k}, 'y', {YES if good else NO}, 't', {t}, 'b', {b}, 'n', {n})" for k, good, t, b, n in made
        ]
        cases.append(f"when {kind} then array({', '.join(each)})")
    return f"case c.k {' '.join(cases)} end"


def candidates(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """(doc_id, held, base, loose, labelled): base spans, well-formed generated spans, and labelled feature patterns."""
    named = [(f"b{k}", BASE[kind], _GUARD[kind], k) for k, kind in enumerate(KINDS)]
    named += [(f"l{i}", p, guard, kind) for i, (kind, p, guard) in enumerate(LOOSE)]
    df = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    )
    none = "cast(array() as array<string>)"
    df = df.selectExpr("*", *[
        f"if({guard}, regexp_extract_all(text, {_quoted(p)}, 0), {none}) as m_{n}" for n, p, guard, _ in named
    ])
    df = df.selectExpr("*", *[
        f"if(size(m_{n}) = 0, {none}, split(text, {_quoted(p)}, -1)) as p_{n}" for n, p, _, _ in named
    ])
    every = {x: ", ".join(_spans(n, k, rules.context_chars) for n, _, _, k in named if n[0] == x) for x in "bl"}
    df = df.selectExpr("doc_id", f"concat({every['b']}) as base", f"concat({every['l']}) as loose")
    df = df.selectExpr(
        "doc_id",
        f"transform(base, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 't', c.t, 'b', c.b, 'n', c.n, 'valid', {_VALID})) as base",
        f"filter(loose, c -> {_VALID}) as loose",
    )
    bits = " + ".join(f"if({f}, {1 << i}, 0)" for i, f in enumerate(FEATURES))
    own = f"transform(base, c -> named_struct('k', c.k, 'y', case when c.valid then {YES} when c.k = {CARD} then {FAILED} else {NO} end, 't', c.t, 'b', c.b, 'n', c.n))"
    labelled = f"concat({own}, flatten(transform(filter(base, c -> c.valid), c -> {_variants()})))"
    remainder, modulus = rules.held_out
    return df.selectExpr(
        "doc_id", f"crc32(coalesce(cast(doc_id as string), '')) % {modulus} = {remainder} as held",
        "transform(filter(base, c -> c.valid), c -> named_struct('k', c.k, 's', c.s, 'e', c.e)) as base",
        f"transform(loose, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'f', {bits})) as loose",
        f"transform({labelled}, c -> named_struct('k', c.k, 'y', c.y, 'f', {bits})) as labelled",
    )


def pattern_sums(found: DataFrame) -> list[tuple[int, int, int, bool, int]]:
    """(kind, feature bits, label, held out, count) over all labelled spans; at most 4 * 2^13 * 6 rows."""
    rows = (
        found.where("size(labelled) > 0").select("held", F.explode("labelled").alias("c"))
        .groupBy("c.k", "c.f", "c.y", "held").agg(F.count("*").alias("n"))
    )
    return sorted((r.k, r.f, r.y, r.held, r.n) for r in rows.collect())


def weighed(sums, kind: int, held: bool) -> list[tuple[int, float, float]]:
    """(feature bits, label 0 or 1, weight) of a kind, in or out of the held-out part."""
    counts: dict[int, list[float]] = {}
    for k, f, y, h, n in sums:
        if k == kind and h == held:
            counts.setdefault(f, [0, 0, 0])[y] += n
    out = []
    for f, (no, yes, failed) in sorted(counts.items()):
        chance = min(yes, failed * CHANCE)
        out += [(f, 0.0, no + chance), (f, 1.0, yes - chance)]
    return [x for x in out if x[2]]


def fit(data: list[tuple[int, float, float]], rules: PiiRules = PiiRules()) -> list[tuple[int, int, tuple[float, ...]]]:
    """Boosted trees of depth two: (first bit, second bit, leaf values by the two bits)."""
    if len({y for _, y, _ in data}) < 2:
        return []
    score, trees, width = [0.0] * len(data), [], len(FEATURES)
    for _ in range(rules.rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        best = None
        for i in range(width):
            for j in range(i + 1, width):
                g, h = [0.0] * 4, [1.0] * 4
                for (bits, y, n), q in zip(data, p):
                    leaf = 2 * (bits >> i & 1) + (bits >> j & 1)
                    g[leaf] += n * (y - q)
                    h[leaf] += n * q * (1 - q)
                gain = sum(a * a / b for a, b in zip(g, h))
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, i, j, tuple(rules.learning_rate * a / b for a, b in zip(g, h)))
        _, i, j, leaves = best
        trees.append((i, j, leaves))
        score = [s + leaves[2 * (b >> i & 1) + (b >> j & 1)] for s, (b, _, _) in zip(score, data)]
    return trees


def tree_score(bits: int, trees) -> float:
    return sum(leaves[2 * (bits >> i & 1) + (bits >> j & 1)] for i, j, leaves in trees)


def threshold(data, trees, rules: PiiRules = PiiRules()) -> tuple[float, float, float]:
    """The lowest score from which on the labelled precision holds, with precision and recall there; infinite if none."""
    scored = sorted(((tree_score(f, trees), y, w) for f, y, w in data), reverse=True)
    good = every = 0.0
    best, total = (math.inf, 1.0, 0.0), sum(y * w for _, y, w in scored)
    for pos, (s, y, w) in enumerate(scored):
        good, every = good + w * y, every + w
        last = pos + 1 == len(scored) or scored[pos + 1][0] < s - 1e-9
        if trees and last and good and good >= rules.precision * every:
            best = (s - 1e-9, good / every, good / total)
    return best


def learn(found: DataFrame, rules: PiiRules = PiiRules()) -> list[tuple[list, tuple[float, float, float]]]:
    """For each kind: the trees, and the held-out threshold with its precision and recall."""
    sums, out = pattern_sums(found), []
    for kind in range(len(KINDS)):
        trees = fit(weighed(sums, kind, False), rules)
        out.append((trees, threshold(weighed(sums, kind, True), trees, rules)))
    return out


def accepted_sql(learned) -> str:
    """Is a candidate c accepted?  The trees see 2^13 patterns at most, so the verdicts of all are one bit each of a constant."""
    words, width = [], 1 << len(FEATURES)
    for trees, (least, _, _) in learned:
        for begin in range(0, width, 32):
            verdicts = [trees and tree_score(f, trees) >= least for f in range(begin, begin + 32)]
            words.append(sum(1 << i for i, yes in enumerate(verdicts) if yes))
    table = ", ".join(f"{w}L" for w in words)
    return f"shiftright(get(array({table}), c.k * {width // 32} + c.f div 32), c.f % 32) % 2 = 1"


def detect(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = saved(candidates(docs, rules))
    df = found.selectExpr("doc_id", "base", f"filter(loose, c -> {accepted_sql(learn(found, rules))}) as loose")
    df = df.selectExpr("doc_id", "base", f"{_untouched()} as free").selectExpr("doc_id", "base", f"{_merged()} as added")
    listed = "array_join(transform(array_sort({a}), x -> concat(element_at(array('email', 'ip', 'card', 'phone'), x.k + 1), ':', x.s, ':', x.e)), ',')"
    base = "transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    counts = [f"cast(size(filter(base, x -> x.k = {k})) as bigint) as n_{kind}" for k, kind in enumerate(KINDS)]
    return df.selectExpr(
        "doc_id", *counts, f"sha2({listed.format(a=base)}, 256) as base_sha256",
        f"{listed.format(a=f'concat({base}, added)')} as spans", "cast(size(added) as bigint) as n_added",
    )
