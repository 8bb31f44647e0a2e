"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Base spans come from one pattern and one check for each of four kinds.  High-recall
generators propose further spans, which may overlap (digit runs inside longer ones, numbers
without a plus sign, spelled-out addresses, long runs of letters and digits; the last are of
a fifth kind, secret).  Boosted trees score each candidate from its format and context, and
thresholds for each kind, calibrated on candidates that the trees have not seen (of what is
added, and of the decoys, 2 % at most may be wrong), select what is added; candidates that overlap a base span or a better candidate are left out.

Training: ``PER_TEMPLATE`` written examples of each template, made by hashing a row number,
so the model is the same for every input.  A template plants a span of personal data, or
one that only looks like it (numbers of a card's form with a wrong check digit, order numbers,
versions, time stamps, ISBNs, digests), among other words;
a candidate is positive if it is just the planted span of a template of the first sort, and
negative else, also if it cuts that span.  The labels are not computed from the features.

Positions count code points, end exclusive.  Patterns are written so that they match what
the plain ones match in linear time: possessive repeats, and a start only at the beginning
of a run or where the last match ended.

Defined cases: a null text is empty; repeated rows are handled each; ties in score go to
the longer, then the earlier candidate; an empty table gives no rows; further columns of
``docs`` pass through whatever their names are, unless they clash with an added one, which
then replaces them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace

PER_TEMPLATE = 160
TREES, DEPTH = 12, 4
PRECISION = 0.98

#: The last has no base spans.
KINDS = ["email", "ip", "card", "phone", "secret"]

#: Kind: the pattern of base spans.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

#: (kind, pattern) of the candidate generators.
GENERATORS = [
    ("card", r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])00[1-9][0-9]{0,2}[ .-](?:\(?[0-9]{1,4}\)?[ .-]){1,4}[0-9]{3,5}(?![0-9])"),
    ("phone", r"[+][1-9][0-9]{0,2}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,12}(?![A-Za-z])"),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,200}+[0-9])[A-Za-z0-9_+/-]{16,200}+(?![A-Za-z0-9_+/-])"),
]

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GAP = "[^A-Za-z0-9]{0,6}$"
#: Name of a feature, and what stands before the candidate where it is 1.
_CUES = {
    "cue_card": f"(?i)(?:card|visa|konto|pay|account|credit|iban|[ck]red[a-z]*|karte|tarjeta|carte){_GAP}",
    "cue_phone": f"(?i)(?<![a-z])(?:tel[a-z]*|[a-z]*phone|[a-z]*fon|mobil[a-z]*|cell|call|fax|dial|ring|text|sms|number is){_GAP}",
    "cue_mail": f"(?i)(?<![a-z])(?:mail|contact|write to|reach me|reach us|send to){_GAP}",
    "cue_secret": f"(?i)(?:token|secret|passw[a-z]*|pwd|key|auth|bearer|credential[s]?)(?: is)?{_GAP}",
    "cue_ip": f"(?i)(?<![a-z])(?:ip|addr[a-z]*|host|server|login){_GAP}",
    "cue_version": f"(?i)(?<![a-z])(?:v|ver|version|release|section|chapter){_GAP}",
    "cue_number": f"(?i)(?<![a-z])(?:order|isbn|invoice|ref|serial|ticket|part|no|nr|id|at|on|time|date){_GAP}",
    "cue_digest": f"(?i)(?<![a-z])(?:commit|sha[0-9]*|md5|rev|checksum|digest|hash|etag|build){_GAP}",
    "assigned": "[=:] ?[\"']?$",
    "before_digit": "[0-9][ .-]?$",
    "plus": "[+] ?$",
    "touch_left": r"[\p{L}0-9]$",
}
#: The same for what stands behind it.
_AFTER = {"touch_right": r"^[\p{L}0-9]", "after_digit": "^[ .-]?[0-9]", "quoted": "^[\"']"}
#: Name of a feature, and what counts characters of the candidate.
_COUNTS = {"digits": "[^0-9]", "gaps": "[^ ().-]", "letters": "[^A-Za-z]", "capitals": "[^A-Z]", "beyond_f": "[^G-Zg-z]"}
_FEATURES = ["kind", "len", "luhn", "octets", "year", "different", *_COUNTS, *_CUES, *_AFTER]


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL: start, end, characters, up to 24 characters before and 2 behind of each match of a pattern, from the pieces between them.

    No piece of the text is sought by its position, so long texts with many matches take linear time.
    """
    found, parts = f"regexp_extract_all({text}, {_sql(pattern)}, 0)", f"split({text}, {_sql(pattern)}, -1)"
    left, right = "right(concat(coalesce(get(s.f, i - 1), ''), s.p[i]), 24)", "substring(concat(get(s.p, i + 1), coalesce(get(s.f, i + 1), '')), 1, 2)"
    pieces = f"transform(array(struct({found} as f, {parts} as p)), s -> transform(s.f, (m, i) -> struct(length(s.p[i]) as gap, m as chars, {left} as left, {right} as right)))[0]"
    # Running sums in groups of 256 and over the groups: an aggregate copies what it has gathered at each step.
    run = "(a, y) -> concat(a, array(element_at(a, -1) + y.gap + length(y.chars)))"
    groups = "transform(sequence(0, greatest(0, size(x) - 1) div 256), c -> slice(x, cast(c * 256 + 1 as int), 256))"
    begins = "aggregate(g, array(0), (a, ch) -> concat(a, array(element_at(a, -1) + aggregate(ch, 0, (s, y) -> s + y.gap + length(y.chars)))))"
    span = "(y, at) -> struct(at + y.gap as start, at + y.gap + length(y.chars) as end, y.chars as chars, y.left as left, y.right as right)"
    spans = f"flatten(transform(g, (ch, c) -> zip_with(ch, slice(aggregate(ch, array(o[c]), {run}), 1, size(ch)), {span})))"
    return f"transform(array({pieces}), x -> transform(array({groups}), g -> transform(array({begins}), o -> {spans})[0])[0])[0]"


def _digits(chars: str) -> str:
    return f"regexp_replace({chars}, '[^0-9]', '')"


_DOUBLED = "(cast(substring(d, i, 1) as int) * (1 + (length(d) - i) % 2))"
_LUHN_SUM = f"aggregate(sequence(1, length(d)), 0L, (s, i) -> s + {_DOUBLED} div 10 + {_DOUBLED} % 10)"


def _luhn(digits: str) -> str:
    return f"(transform(array({digits}), d -> length(d) between 12 and 19 and {_LUHN_SUM} % 10 = 0)[0])"


def _checked(body: str, off: str = "0") -> str:
    """The digits with a check digit behind them, or one that is ``off`` by so much."""
    return f"(transform(array(concat({body}, '0')), d -> concat(left(d, length(d) - 1), cast(pmod({off} - {_LUHN_SUM}, 10) as string)))[0])"


def _octets(chars: str) -> str:
    return f"({chars} rlike {_sql(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')})"


def _valid(kind: str, chars: str) -> str:
    return {
        "email": "true",
        "ip": _octets(chars),
        "card": f"if(length({_digits(chars)}) between 12 and 19, {_luhn(_digits(chars))}, false)",
        "phone": f"length({_digits(chars)}) between 9 and 15",
    }[kind]


def _none(kind: str = "array<struct<start:int,k:int,end:int>>") -> str:
    return f"cast(array() as {kind})"


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (the columns of ``docs``), _text (never null) and an array of spans for each kind: start, k (number of the kind), end."""
    out = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    may = {"email": "instr(_text, '@') > 0", "phone": "instr(_text, '+') > 0"}
    for k, kind in enumerate(BASE):
        spans = f"transform(filter({_matches('_text', BASE[kind])}, m -> {_valid(kind, 'm.chars')}), m -> struct(m.start as start, {k} as k, m.end as end))"
        out = out.withColumn(f"_{kind}", F.expr(f"if({may.get(kind, _DIGIT)}, {spans}, {_none()})"))
    return out.withColumn("_base", F.expr("array_sort(concat(" + ", ".join(f"_{k}" for k in BASE) + "))"))


_DIGIT = "_text rlike '[0-9]'"


def candidates(based: DataFrame) -> DataFrame:
    """Adds _candidates: spans of _text with their features."""
    some = []
    left, right = "m.left", "m.right"
    for kind, pattern in GENERATORS:
        of = {
            "kind": KINDS.index(kind),
            "len": "length(m.chars)",
            "luhn": _luhn(_digits("m.chars")),
            "octets": _octets("m.chars"),
            "year": "(m.chars rlike '^(?:19|20)[0-9][0-9]')",
            "different": "size(array_distinct(split(m.chars, '')))",
            **{f: f"length(regexp_replace(m.chars, {_sql(others)}, ''))" for f, others in _COUNTS.items()},
            **{f: f"({left} rlike {_sql(cue)})" for f, cue in _CUES.items()},
            **{f: f"({right} rlike {_sql(cue)})" for f, cue in _AFTER.items()},
        }
        features = ", ".join(f"cast({v} as double) as {f}" for f, v in of.items())
        found = f"transform({_matches('_text', pattern)}, m -> struct(m.start as start, {KINDS.index(kind)} as k, m.end as end, {features}))"
        if kind == "card":  # without its check digit a number is proposed behind words for cards only
            found = f"filter({found}, c -> c.luhn = 1 or c.cue_card = 1)"
        need = "(instr(_text, '@') > 0 or instr(_text, 'at') > 0)" if kind == "email" else _DIGIT
        some.append(f"if({need}, {found}, {_none(_CANDIDATE)})")
    return based.withColumn("_candidates", F.expr(f"concat({', '.join(some)})"))


_CANDIDATE = "array<struct<start:int,k:int,end:int," + ",".join(f"{f}:double" for f in _FEATURES) + ">>"


def _made(what: str, n: int, salt: str = "") -> str:
    """SQL: n characters from the row's number."""
    digest = f"sha2(concat(id, '{what}{salt}'), 256)"
    return {
        "digits": f"substring(translate({digest}, 'abcdef', '271834'), 1, {n})",
        "hex": f"substring({digest}, 1, {n})",
        "mixed": f"substring(translate(base64(unhex({digest})), '+/=', 'x7Q'), 1, {n})",
        "letters": f"substring(translate({digest}, '0123456789', 'etaoinshrl'), 1, {n})",
    }[what]


def _one_of(salt: str, *words: str) -> str:
    return f"element_at(array({', '.join(_sql(w) for w in words)}), 1 + cast(pmod(xxhash64(id, '{salt}'), {len(words)}) as int))"


def _templates() -> list[tuple[str, bool, str, str, str]]:
    """(kind, whether it is personal, what stands before, the span, what stands behind), in SQL over ``id``.

    Numbers of cards have a check digit; decoys of the same form and surroundings have none.
    """

    def d(n: int, salt: str = "") -> str:
        return _made("digits", n, salt)

    def grouped(number: str) -> str:
        return f"transform(array({number}), x -> concat_ws({_one_of('gap', ' ', '-')}, substring(x, 1, 4), substring(x, 5, 4), substring(x, 9, 4), substring(x, 13)))[0]"

    any_word, end = "' '", _one_of("end", " ", ", ", ". ", "!! ", "### ", "\n", " | ")
    card, phone, mail = _one_of("c", "card ", "visa: ", "account ", "pay to "), _one_of("p", "tel ", "phone: ", "call ", "fax ", "telephone ", "mobile: ", "dial "), _one_of("m", "mail ", "contact: ", "write to ")
    number, digest = _one_of("n", "order ", "invoice no. ", "serial ", "ticket id: ", "ref "), _one_of("g", "commit ", "sha1: ", "md5 = ", "checksum ", "etag: \"", "build ")
    secret = _one_of("s", "token = \"", "api_key=", "secret: ", "password = '", "TOKEN = \"", "auth: ", "key = \"")
    host, version = _one_of("h", "ip ", "address: ", "host ", "server ", "login "), _one_of("v", "version ", "v", "release ", "section ", "chapter ")
    off = "(1 + pmod(xxhash64(id, 'off'), 9))"
    good, bad = _checked(d(15)), _checked(d(15), off)
    us, local = f"concat('(', {d(3)}, ') ', {d(3, 'b')}, '-', {d(4, 'c')})", f"concat_ws({_one_of('gap', '-', '.', ' ')}, {d(3)}, {d(3, 'b')}, {d(4, 'c')})"
    abroad = f"concat('00', {_one_of('cc', '49', '33', '1', '351')}, ' ', {d(3)}, ' ', {d(3, 'b')}, ' ', {d(4, 'c')})"
    spelled = f"concat({_made('letters', 6)}, {_one_of('at', ' [at] ', ' (at) ', '[at]')}, {_made('letters', 7, 'b')}, {_one_of('dot', ' [dot] ', ' (dot) ', '.')}, {_one_of('tld', 'com', 'org', 'de')})"
    stamp = f"concat({_one_of('y', '2019', '2023', '1998')}, {_one_of('mo', '01', '07', '12')}, {_one_of('da', '03', '17', '28')}, {d(6)})"
    part = lambda salt, most: f"cast(pmod(xxhash64(id, '{salt}'), {most}) as string)"
    address = f"concat_ws('.', {part('o1', 256)}, {part('o2', 256)}, {part('o3', 256)}, {part('o4', 256)})"
    return [
        ("card", True, any_word, good, end),
        ("card", True, card, good, end),
        ("card", True, any_word, grouped(good), end),
        ("card", True, card, grouped(good), end),
        ("card", True, card, _checked(d(14)), end),
        ("card", True, f"concat(' ', {d(2, 'q')}, ' ')", good, end),
        ("card", True, card, bad, end),
        ("card", True, card, grouped(bad), end),
        ("card", False, any_word, bad, end),
        ("card", False, any_word, bad, f"concat(' ', {d(4, 'z')}, ' ')"),
        ("card", False, any_word, grouped(bad), end),
        ("card", False, f"concat(' ', {d(2, 'q')}, ' ')", bad, end),
        ("card", False, number, bad, end),
        ("card", False, number, grouped(bad), end),
        ("card", False, number, d(13), end),
        ("card", False, any_word, _checked(d(11), off), end),
        ("card", False, any_word, stamp, end),
        ("card", False, any_word, _checked(d(18), off), end),
        ("card", False, f"concat(' ', {_made('letters', 3)})", d(16), _made("letters", 2, "b")),
        ("card", False, f"concat(' ', {d(4)}, '.')", bad, end),
        ("phone", True, any_word, us, end),
        ("phone", True, phone, us, end),
        ("phone", True, phone, local, end),
        ("phone", True, any_word, local, end),
        ("phone", True, phone, abroad, end),
        ("phone", True, any_word, abroad, end),
        ("phone", True, phone, us, _one_of("e2", ".", ",", ";")),
        ("phone", True, phone, local, _one_of("e2", ".", ",", ";")),
        ("phone", True, phone, abroad, _one_of("e2", ".", ",", ";")),
        ("phone", True, any_word, f"concat('+', {_one_of('cc', '49', '33', '1', '351')}, ' ', {us})", f"concat(' ', {d(16, 'z')})"),
        ("phone", True, phone, f"concat('+', {_one_of('cc', '49', '33', '1', '351')}, ' ', {local})", end),
        ("phone", False, number, local, end),
        ("phone", False, f"concat(' ', {d(5)}, '-')", local, end),
        ("phone", False, any_word, local, f"concat('-', {d(4, 'z')})"),
        ("email", True, any_word, spelled, end),
        ("email", True, mail, spelled, end),
        ("email", False, any_word, f"concat({_made('letters', 4)}, ' at ', {_made('letters', 5, 'b')})", end),
        ("ip", True, host, address, end),
        ("ip", True, any_word, address, end),
        ("ip", True, f"concat(' ', {d(4, 'q')}, '.')", address, end),
        ("ip", False, version, f"concat_ws('.', {part('o1', 20)}, {part('o2', 20)}, {part('o3', 20)}, {part('o4', 99)})", end),
        ("ip", False, any_word, f"concat('999.', {d(3)}, '.', {d(3, 'b')}, '.777')", end),
        ("ip", False, host, f"concat('4', {d(2)}, '.', {part('o2', 256)}, '.', {part('o3', 256)}, '.3', {d(2, 'b')})", end),
        ("secret", True, secret, _made("hex", 40), _one_of("q", "\" ", "' ", " ", "\"!! ")),
        ("secret", True, secret, f"upper({_made('hex', 40)})", _one_of("q", "\" ", "' ", "\"### ")),
        ("secret", True, secret, _made("mixed", 32), _one_of("q", "\" ", "' ", " ")),
        ("secret", True, secret, _made("hex", 32), _one_of("q", "\" ", "' ", " ")),
        ("secret", False, digest, _made("hex", 40), end),
        ("secret", False, digest, _made("hex", 32), _one_of("q", "\" ", " ", ". ")),
        ("secret", False, any_word, _made("hex", 40), end),
        ("secret", False, number, f"concat({_made('letters', 12)}, '-', {d(6)})", end),
        ("secret", False, any_word, f"concat({_made('letters', 9)}, '_', {_made('letters', 8, 'b')}, '/v', {d(1)})", end),
        ("secret", False, secret, f"concat({_made('letters', 8)}, '-', {_made('letters', 9, 'b')}, '-', {d(1)})", end),
        ("secret", False, any_word, bad, end),
    ]


def examples(spark: SparkSession, work: Workspace, per_template: int = PER_TEMPLATE) -> DataFrame:
    """The features of the candidates of written texts, with label, k and held (not for the trees)."""
    ids = spark.range(0, per_template, 1, 1)
    rows = reduce(
        DataFrame.unionByName,
        [
            ids.select(
                "id", F.lit(KINDS.index(kind)).alias("own"), F.lit(personal).alias("personal"), F.expr(f"concat({_made('letters', 5, 'x')}, ' ', {_made('letters', 4, 'y')}, ' ', {before})").alias("before"),
                F.expr(span).alias("span"), F.expr(f"concat({behind}, {_made('letters', 6, 'z')})").alias("behind"),
            )
            for kind, personal, before, span, behind in _templates()
        ],
    )
    rows = work.table(rows.select("*", F.concat("before", "span", "behind").alias("_text")).coalesce(4), "examples")
    flat = candidates(rows).select("id", "personal", "own", F.length("before").alias("at"), F.length("span").alias("n"), F.explode("_candidates").alias("c"))
    just = F.expr("personal and own = c.k and c.start = at and c.end = at + n")
    return flat.select("c.*", just.cast("double").alias("label"), (F.col("id") % 4 == 0).alias("held"))


_models: dict[tuple[str, int], tuple[list[str], dict[int, float]]] = {}


def train(spark: SparkSession, per_template: int = PER_TEMPLATE) -> tuple[list[str], dict[int, float]]:
    """The trees as SQL over a candidate ``c``, and a threshold for each kind; once for each application, as the examples are the same."""
    key = (spark.sparkContext.applicationId, per_template)
    if key not in _models:
        _models[key] = _train(spark, per_template)
    return _models[key]


def _train(spark: SparkSession, per_template: int) -> tuple[list[str], dict[int, float]]:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    work = Workspace(spark, "pii")
    flat = work.table(examples(spark, work, per_template), "candidates")
    table = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(flat)
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False).fit(table.filter("not held"))
    trees = [_tree_sql(t.toDebugString, w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    scored = flat.filter("held").select("k", "label", F.floor(F.expr(_probability(trees, "")) * 20).alias("bin"))
    bins = scored.groupBy("k", "bin").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()  # 100 rows at most
    work.drop()
    at = {}
    for k in range(len(KINDS)):
        yes = total = 0
        decoys = sum(r.n - r.yes for r in bins if r.k == k)
        for r in sorted((r for r in bins if r.k == k), key=lambda r: -r.bin):
            yes, total = yes + r.yes, total + r.n
            if yes >= PRECISION * total and total - yes <= (1 - PRECISION) * decoys and r.bin >= 10:
                at[k] = r.bin / 20
    return trees, at


def _tree_sql(text: str, weight: float) -> str:
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node() -> str:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1]) * weight!r}D"
        feature, cut = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line).groups()
        yes = node()
        lines.pop(0)
        return f"if(c.{_FEATURES[int(feature)]} <= {float(cut)!r}D, {yes}, {node()})"

    return node()


def _probability(trees: list[str], c: str) -> str:
    return f"(1 / (1 + exp(-2 * ({' + '.join(t.replace('c.', c) for t in trees)}))))"


def find(docs: DataFrame, *, text: str = "text", per_template: int = PER_TEMPLATE) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), base and spans: arrays of (start, k, end), by start and kind."""
    trees, at = train(docs.sparkSession, per_template)
    level = "element_at(map(" + ", ".join(f"{k}, {at.get(k, 2.0)}D" for k in range(len(KINDS))) + "), c.k)"
    scored = f"filter(transform(_candidates, c -> struct(-{_probability(trees, 'c.')} as p, c.start - c.end as size, c.start as start, c.k as k, c.end as end, {level} as level)), c -> -c.p >= c.level)"
    # few candidates come so far; only they are held against the base spans
    picked = f"filter({scored}, c -> not exists(_base, b -> b.start < c.end and c.start < b.end))"
    greedy = f"aggregate(array_sort({picked}), {_none()}, (a, c) -> if(exists(a, b -> b.start < c.end and c.start < b.end), a, concat(a, array(struct(c.start as start, c.k as k, c.end as end)))))"
    found = candidates(base_spans(docs, text)).withColumn("_added", F.expr(f"if(size(_candidates) = 0, {_none()}, {greedy})"))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    added = [*(f"n_{k}" for k in BASE), "base", "spans"]
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *counts, F.col("_base").alias("base"), F.expr("array_sort(concat(_base, _added))").alias("spans"))


def _written(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.k], ':', s.start, ':', s.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``find`` returns, and n_spans, the number of all spans."""
    return found.select(
        "doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.expr(_written("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_written("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )


def redacted(found: DataFrame, text: str = "text") -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, its end moved on."""
    names = "array(" + ", ".join(f"'<{k}>'" for k in KINDS) + ")"
    return F.expr(
        f"if(size(spans) = 0, {text}, aggregate(spans, struct(0 as at, '' as out), (a, s) -> if(s.start < a.at,"
        f" struct(greatest(a.at, s.end) as at, a.out as out),"
        f" struct(s.end as at, concat(a.out, substring({text}, a.at + 1, s.start - a.at), {names}[s.k]) as out)),"
        f" a -> concat(a.out, substring({text}, a.at + 1))))"
    )


def redact(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; a null text stays null.  Columns keep their values, whatever their names."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    found = find(packed, **options)
    return found.withColumn("text", redacted(found)).select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def brute_force(doc_id: int, text: str | None) -> tuple:
    """The contract's base columns by plain search, for tests."""
    import hashlib

    text, out = text or "", []
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, pattern in enumerate(plain):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return doc_id, *(sum(x[1] == k for x in out) for k in range(4)), hashlib.sha256(said.encode()).hexdigest()
