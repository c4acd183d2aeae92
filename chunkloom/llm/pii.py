"""Personal data by weak supervision, with DataFrame operations only.

1. Regular expressions mark candidate spans in whole texts: those of the base kinds, and looser ones (written-out e-mail
   addresses, national phone numbers, bank and social security numbers, keys and tokens) that need evidence.
2. Labelers vote on every candidate (1 yes, 0 no, - no opinion): strict form, gazetteers, words before it, its
   neighbours, its repetitiveness. Expectation-maximisation over the votes' patterns (at most 3^5 a kind) estimates each
   labeler's reliability and every pattern's probability, without labels.
3. Those probabilities train the final span classifier: naive Bayes over the span's features, for each kind. Loose candidates stay if
   it finds them likelier than not; valid base candidates always stay.

One pass reads the texts; it leaves one small row a document in the shared folder, where all else starts. Offsets are in
code points. Prefix sums over a document's candidates run in chunks of 256, so no step is quadratic in their number.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.storage import staged

OPEN, CLOSE, OTHER = "", "", ""
#: name -> (kind, base, cheap test, regular expression). The base ones are fixed; atomic forms of them give the same matches in linear time.
CANDIDATES = {
    "email": ("email", True, "instr(t, '@') > 0", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, r"t rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("card", True, r"t rlike '[0-9][ -]?[0-9]'", r"[0-9](?:[ -]?[0-9])++"),
    "phone": ("phone", True, "instr(t, '+') > 0", r"\+[0-9][ ().0-9-]+[0-9]"),
    "written": ("email", False, r"t rlike '[\\[( ][aA][tT][]) ]'", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,}+"),
    "national": ("phone", False, r"t rlike '[0-9]{3}[ .)-]'", r"(?<![0-9+])(?<![0-9][ .-])(?<!\+[0-9]{1,3}[ .-]{0,2})(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])"),
    "iban": ("iban", False, r"t rlike '[A-Z]{2}[0-9]{2}'", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": ("ssn", False, r"t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": ("secret", False, r"t rlike '[A-Za-z0-9+/_-]{20}'", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,128}+(?![A-Za-z0-9+/_-])"),
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
CONTEXT = 32
#: Words before a span that speak for its kind.
CUES = {
    "email": "mail|contact|write|address|reach",
    "ip": "ip|host|server|address|node|addr",
    "card": "card|visa|credit|debit|payment|account",
    "phone": "phone|tel|call|mobile|fax|contact|whatsapp",
    "iban": "iban|bank|account|transfer|konto|cuenta",
    "ssn": "ssn|social|security|insurance",
    "secret": "token|secret|passw|api.?key|access.?key|private.?key|auth|credential|bearer",
}
#: Top-level domains, first digits of cards, country codes of bank accounts, lengths and beginnings of keys.
GAZETTEER = {
    "email": r"(?i)[. ](com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(3[47]|4|5[1-5]|6)",
    "phone": r"^\+?[^0-9]*[1-9]",
    "iban": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]+|xox[abprs]-.*|sk-.*|eyJ.*)$",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@.*\.[A-Za-z]{2,}$",
    "ip": r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}",
    "card": r"^(?:[0-9]{4}[ -]?){3,4}[0-9]{0,7}$",
    "phone": r"^\+[0-9]{1,3}[ (.-]|^\([0-9]{3}\) ?[0-9]{3}-",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "secret": r"^(?=(?:[^0-9]*[0-9]){5})(?=(?:[^A-Za-z]*[A-Za-z]){5})[A-Za-z0-9+/_-]+$",
}
LABELERS = 5
CHUNK, ROUNDS = 256, 60
_ITEMS = "array<struct<n:bigint,v:string,tail:string,head:string>>"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def marked(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and, for each candidate expression with a match, the pieces that its matches cut the text into.

    A piece: n, its code points; v, the match at its start (all but the first piece); tail, its last characters;
    head, the character behind the match.
    """
    rows = docs.select(*keep, F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, OTHER * 2).alias("t"))
    cols = []
    for name, (_, _, test, regex) in CANDIDATES.items():
        pieces = f"split(regexp_replace(t, {_literal(regex)}, '{OPEN}$0{CLOSE}'), '{OPEN}')"
        value, rest = f"substring_index(p, '{CLOSE}', 1)", f"substring_index(p, '{CLOSE}', -1)"
        item = f"named_struct('n', cast(length(p) - if(i > 0, 1, 0) as bigint), 'v', if(i > 0, {value}, ''), 'tail', right({rest}, {CONTEXT}), 'head', left({rest}, 1))"
        cols.append(F.expr(f"CASE WHEN {test} THEN transform({pieces}, (p, i) -> {item}) END").alias(name))
    return rows.select(*keep, *cols)


def _starts(items: str) -> str:
    """SQL for the code points before each piece."""
    chunks = f"transform(sequence(0, (size({items}) - 1) div {CHUNK}), k -> slice({items}, k * {CHUNK} + 1, {CHUNK}))"
    sums = lambda data, n: f"aggregate({data}, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (a, x) -> named_struct('at', a.at + {n}, 'out', array_append(a.out, a.at)), a -> a.out)"
    total = "aggregate(x, 0L, (s, y) -> s + y.n)"
    return f"flatten(zip_with({chunks}, {sums(chunks, total)}, (c, s) -> transform({sums('c', 'x.n')}, z -> z + s)))"


def candidates(pieces: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and `c`, the row's candidates that pass their kind's test: kind, base, start, stop, votes, features."""
    every = []
    for name, (kind, base, _, _) in CANDIDATES.items():
        digits = "regexp_replace(x.v, '[^0-9]', '')"
        valid = {
            "ip": f"x.v rlike {_literal(STRICT['ip'])}",
            "card": f"length({digits}) BETWEEN 12 AND 19 AND luhn_check({digits})",
            "phone": f"length({digits}) BETWEEN 9 AND 15",
        }.get(name, "true")
        vote = lambda yes, no: f"CASE WHEN {yes} THEN '1' WHEN {no} THEN '0' ELSE '-' END"
        cue = f"lower(x.tail) rlike {_literal(CUES[kind])}"
        votes = [
            vote(f"x.v rlike {_literal(STRICT[kind])}", "true"),
            vote(f"x.v rlike {_literal(GAZETTEER[kind])}", "true"),
            vote(cue, "lower(x.tail) rlike '(version|id|key|token|hash|v|=|no[.]) ?$'"),
            vote("(x.tail = '' OR right(x.tail, 1) rlike '[ \\\\n\\\\t(<,:;]') AND (x.head = '' OR x.head rlike '[ \\\\n\\\\t)>,.;!?]')", "x.head rlike '[A-Za-z0-9_/=]' OR right(x.tail, 1) rlike '[A-Za-z0-9_/=]'"),
            vote(f"length(regexp_replace({digits}, '(.)(?=.*\\\\1)', '')) >= 4", f"length({digits}) >= 7"),
        ]
        features = [
            f"'{name}'",
            "concat('n', least(length(x.v) div 4, 10))",
            f"concat('d', least(length({digits}) div 2, 10))",
            "concat('b', if(x.tail = '', '^', regexp_replace(regexp_replace(right(x.tail, 1), '[0-9]', '0'), '\\\\p{L}', 'a')))",
            "concat('a', if(x.head = '', '$', regexp_replace(regexp_replace(x.head, '[0-9]', '0'), '\\\\p{L}', 'a')))",
            f"concat('c', {cue})",
        ]
        features[3:5] = [f"if(length({f}) <= 2 AND {f} rlike '^.[\\\\x20-\\\\x7e]$', {f}, concat(left({f}, 1), '?'))" for f in features[3:5]]
        key = ", ".join(f"concat('{kind}|', {f})" for f in features)
        struct = f"named_struct('kind', '{kind}', 'base', {str(base).lower()}, 'start', x.start, 'stop', x.start + length(x.v), 'votes', concat('{kind}:', {', '.join(votes)}), 'features', array({key}))"
        joined = f"zip_with(zip_with({name}, {_starts(name)}, (p, s) -> named_struct('v', p.v, 'start', s, 'head', p.head)), concat(array(''), transform({name}, p -> p.tail)), (p, t) -> named_struct('v', p.v, 'start', p.start, 'head', p.head, 'tail', t))"
        found = f"filter(slice({joined}, 2, greatest(size({name}) - 1, 0)), x -> {valid})"
        every.append(f"CASE WHEN size({name}) > 1 THEN transform({found}, x -> {struct}) ELSE array() END")
    kind = "struct<kind:string,base:boolean,start:bigint,stop:bigint,votes:string,features:array<string>>"
    return pieces.select(*keep, F.expr(f"concat({', '.join(f'cast({e} as array<{kind}>)' for e in every)})").alias("c"))


def reliabilities(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Probability that a candidate with a vote pattern ("kind:votes") is personal data.

    Two classes a kind; a labeler's votes are independent given the class. The start is the majority's opinion, each
    round estimates the class sizes and every labeler's votes in either class (with one count of each added).
    """
    by_kind: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for p, n in sorted(patterns.items()):
        kind, votes = p.split(":")
        by_kind[kind].append((votes, n))
    out = {}
    for kind, rows in by_kind.items():
        post = [(1 + v.count("1")) / (2 + v.count("1") + v.count("0")) for v, _ in rows]
        for _ in range(rounds):
            size = [sum(n * p for (_, n), p in zip(rows, post, strict=True)) + 1, sum(n * (1 - p) for (_, n), p in zip(rows, post, strict=True)) + 1]
            table = [[{x: 1.0 for x in "10-"} for _ in range(LABELERS)] for _ in range(2)]
            for (v, n), p in zip(rows, post, strict=True):
                for i, x in enumerate(v):
                    table[0][i][x] += n * p
                    table[1][i][x] += n * (1 - p)
            new = []
            for v, _ in rows:
                score = [math.log(size[c]) + sum(math.log(table[c][i][x] / sum(table[c][i].values())) for i, x in enumerate(v)) for c in (0, 1)]
                new.append(1 / (1 + math.exp(max(-50.0, min(50.0, score[1] - score[0])))))
            done = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0) < 1e-9
            post = new
            if done:
                break
        out |= {f"{kind}:{v}": p for (v, _), p in zip(rows, post, strict=True)}
    return out


def _map(values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")


def train(found: DataFrame) -> dict[str, float]:
    """Naive Bayes weights (log odds) by feature, which starts with its kind; a kind's name alone is its prior. Patterns and feature values are few, whatever the data."""
    each = found.select(F.explode("c").alias("c")).select("c.kind", "c.votes", "c.features")
    post = reliabilities({r["votes"]: r["n"] for r in each.groupBy("votes").agg(F.count("*").alias("n")).collect()})
    p = each.withColumn("p", F.element_at(_map(post), F.col("votes")))
    rows = p.select("kind", F.posexplode(F.concat("features", F.array("kind"))).alias("slot", "f"), "p").groupBy("kind", "slot", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    values = Counter((r["kind"], r["slot"]) for r in rows)
    total = {r["f"]: (r["yes"], r["no"]) for r in rows if r["f"] == r["kind"]}

    def odds(r) -> float:
        yes, no = total[r["kind"]]
        if r["f"] == r["kind"]:
            return math.log((yes + 1) / (no + 1))
        more = (values[r["kind"], r["slot"]] + 1) / 2  # half a count of each of the slot's values, and of one not seen
        return math.log((r["yes"] + 0.5) / (yes + more)) - math.log((r["no"] + 0.5) / (no + more))

    return {r["f"]: round(odds(r), 9) for r in rows}


def pii_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` (doc_id if none) and `spans` of every row: kind, start, stop (exclusive), base; by start, then kind.

    Null and empty texts have no spans. Repeated rows stay. Base spans of different kinds may overlap.
    """
    keep = keep or ("doc_id",)
    found = candidates(staged(marked(docs, *keep), "pii-pieces"), *keep)
    weights = _map(train(found))
    score = "aggregate(concat(x.features, array(x.kind)), 0D, (s, f) -> s + coalesce(element_at(w, f), 0D))"
    order = f"array_position(array({', '.join(repr(k) for k in KINDS)}), x.kind)"
    kept = F.expr(f"array_sort(transform(filter(c, x -> x.base OR {score} > 0), x -> named_struct('start', x.start, 'k', {order}, 'kind', x.kind, 'stop', x.stop, 'base', x.base)))")
    return found.withColumn("w", weights).select(*keep, kept.alias("spans"))


def redacted(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` (text among them) with every span of the text replaced by its kind in angle brackets; of overlapping spans the first. Null texts stay null."""
    step = "if(x.start < a.at, a, named_struct('at', x.stop, 'parts', concat(a.parts, array(substring(text, cast(a.at as int) + 1, cast(x.start - a.at as int)), concat('<', x.kind, '>')))))"
    masked = f"aggregate(spans, named_struct('at', 0L, 'parts', cast(array() as array<string>)), (a, x) -> {step}, a -> concat(array_join(a.parts, ''), substring(text, cast(a.at as int) + 1)))"
    return pii_spans(docs, *keep).select(*(F.expr(f"CASE WHEN size(spans) > 0 THEN {masked} ELSE text END").alias("text") if c == "text" else c for c in keep))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and hashes of pii_spans, a row each: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added
    (spans that the method adds), has_pii (1 if there is any span).

    Null and empty texts have no spans, so empty strings and counts of 0. Repeated rows stay, null ids too; other columns
    are not read. Spans that start together are in the order of the kinds. An empty table gives no rows.
    """
    text = lambda a: f"array_join(transform({a}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    base = "filter(spans, x -> x.base)"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base AND x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    added = F.expr("cast(size(filter(spans, x -> NOT x.base)) as bigint)").alias("n_added")
    return pii_spans(docs).select("doc_id", *counts, F.sha2(F.expr(text(base)).cast("binary"), 256).alias("base_sha256"), F.expr(text("spans")).alias("spans"), added, (F.size("spans") > 0).cast("int").alias("has_pii"))
