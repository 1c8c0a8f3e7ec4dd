"""Personal data by candidate gradient boosting, in DataFrame operations only.

Exact rules give the base spans. Beside them generators of high recall propose
further spans, which may overlap; boosted trees judge their format and context,
and a calibrated threshold selects those that are redacted as well. The trees
learn from the candidates of the corpus that a rule decides: an address that
holds a base span is personal data, a number if base spans cover all its digits,
a secret if the word before it says so; dates, quantities, failed checksums,
digests and names of words and numbers are certainly none. What no rule decides
is not learned from, only judged. Every span that is personal data is learned
from in other formats as well, and in a format that makes it none, and half of
the time without its context: the trees can tell formats that no rule takes, and
no corpus is short of examples of either sort. They see candidates as small
numbers, so that the whole corpus comes down to a table of the different
candidates and their counts.

Everything about a text happens within its row: there is no shuffle of texts.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propense.llm.tables import free_name
from propense.sources.staging import stage

# The base kinds in their order and their patterns. Repetitions are possessive, and a
# pattern that starts with a run of characters is only tried at the run's begin or behind a match:
# both find the same spans as without, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
VALID_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"

# What the generators propose: anything around an at sign, digits with what people put between them,
# and long strings of letters and digits without spaces.
ADDRESS_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9.-]++"
NUMBER_LIKE = r"(?<![A-Za-z0-9+(])[+(]{0,2}[0-9](?:[\x20().-]{0,2}+[0-9]){4,}+(?![A-Za-z])"
SECRET_LIKE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+"
# What a number is as well, and a name that stands before a secret.
NUMBER_ONLY = r"^[0-9](?:[().-]{0,2}+[0-9]){4,}+$"
NAMED_SECRET = r"^([A-Za-z0-9_+/-]++=)(?=[^0-9]*+[0-9])[A-Za-z0-9_+/-][A-Za-z0-9_+/=-]{11,}+$"
ADDED = ("address", "secret", "number")
# Words before a span that say what it is, in the order of their numbers.
CONTEXT = (
    r"(?:token|secret|passw(?:or)?d|api[_ -]?key|key|credential)s?[\"']?\s*(?:=>|[:=]|is)\s*[\"']?$|\bbearer\s+$",
    r"(?:tel|phone|fax|call|mobile|cell|whatsapp)",
    r"(?:mail|contact|write)",
    r"(?:card|visa|mastercard|account|iban|payment)",
    r"(?:\bip\b|host|server|address)",
    r"\b(?:commit|revision|sha-?[0-9]{0,3}|md5|digest|checksum|hash|etag|uuid|version|build)\W{0,3}$",
)
SECRET_CONTEXT, DIGEST_CONTEXT = CONTEXT[0], CONTEXT[5]
# Numbers that are certainly no card, phone or address of a machine: dates and grouped quantities.
DATE = r"^\(?(?:(?:19|20)[0-9]{2}[-. ][01]?[0-9][-. ][0-3]?[0-9]|[0-3]?[0-9][-. ][01]?[0-9][-. ](?:19|20)[0-9]{2})(?![0-9])"
QUANTITY = r"^[0-9]{1,3}(?:[. ][0-9]{3})+$"
CARD_LIKE = r"^[0-9](?:[\x20-]?[0-9]){11,18}$"
DOTTED = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
# Where letters meet digits, and names that are made of words and numbers with signs between.
SEAMS = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
WORDS_AND_NUMBERS = r"^(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))+[-_/=+]*$"
# Characters of context before a span.
CONTEXT_CHARS = 24
SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "struct<start:int,end:int,value:string,before:string,behind:string>"
# Spans whose places are summed up at once: bounds the copying within a text of very many spans.
RUN = 256


@dataclass(frozen=True)
class Settings:
    """Size of the boosted model of each kind, and the share of what is selected of each kind that must be personal data in calibration."""

    trees: int = 10
    depth: int = 4
    rate: float = 0.3
    precision: float = 0.98
    seed: int = 11


def _none(kind: str) -> Column:
    """An empty array of such elements."""
    return F.expr(f"cast(array() as array<{kind}>)")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Use a value several times but compute it once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _matches(text: Column, pattern: str) -> Column:
    """Array of the matches of a pattern: their place, the text, what stands before, and the character behind.

    The text between matches and the matches themselves have the lengths that
    the places are summed up from, in runs of matches.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def located(values: Column, gaps: Column) -> Column:
        items = F.transform(
            values,
            lambda value, i: F.struct(
                value.alias("value"),
                F.length(F.get(gaps, i)).alias("gap"),
                F.length(value).alias("size"),
                F.substring(F.get(gaps, i), -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
                F.substring(F.get(gaps, i + 1), 1, 1).alias("behind"),
            ),
        )

        def run(items: Column, place: Column, first: Column) -> Column:
            empty = F.struct(place.alias("place"), _none(FOUND).alias("spans"))
            return F.aggregate(
                F.slice(items, first * RUN + 1, F.lit(RUN)),
                empty,
                lambda sum_, item: F.struct(
                    (sum_["place"] + item["gap"] + item["size"]).alias("place"),
                    F.concat(sum_["spans"], F.array(_span(item, sum_["place"] + item["gap"]))).alias("spans"),
                ),
            )

        def runs(items: Column) -> Column:
            start = F.struct(F.lit(0).alias("place"), _none(f"array<{FOUND}>").alias("runs"))
            numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))
            return F.flatten(
                F.aggregate(
                    numbers,
                    start,
                    lambda sum_, first: _let(
                        run(items, sum_["place"], first),
                        lambda made: F.struct(
                            made["place"].alias("place"),
                            F.concat(sum_["runs"], F.array(made["spans"])).alias("runs"),
                        ),
                    ),
                )["runs"]
            )

        return _let(items, lambda items: F.when(F.size(items) > 0, runs(items)).otherwise(_none(FOUND)))

    return _let(F.struct(values.alias("v"), gaps.alias("g")), lambda both: located(both["v"], both["g"]))


def _span(item: Column, start: Column) -> Column:
    return F.struct(
        start.alias("start"),
        (start + item["size"]).alias("end"),
        item["value"].alias("value"),
        item["before"].alias("before"),
        item["behind"].alias("behind"),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _base_kind(text: Column, kind: str) -> Column:
    """Array of the valid spans of one base kind: start, number of the kind, end.

    A quick look at what every span of the kind holds spares most texts the search.
    """
    pattern, possible, valid = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), lambda v: v.rlike(VALID_IP)),
        "card": (
            CARD,
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
            lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)),
        ),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15)),
    }[kind]
    found = _matches(text, pattern)
    if valid is not None:
        found = F.filter(found, lambda span: valid(span["value"]))
    number = F.lit(KINDS.index(kind))
    spans = F.transform(
        found, lambda span: F.struct(span["start"].alias("start"), number.alias("kind"), span["end"].alias("end"))
    )
    return F.when(possible, spans).otherwise(_none(SPAN))


def base_spans(text: Column) -> Column:
    """Array of a text's base spans (start, number of the kind, end), by start, then kind; a null text has none."""
    return F.array_sort(F.concat(*[_base_kind(F.coalesce(text, F.lit("")), kind) for kind in KINDS]))


def _count(value: Column, characters: str, most: int) -> Column:
    return F.least(F.length(F.regexp_replace(value, f"[^{characters}]+", "")), F.lit(most))


def _kind(value: Column) -> Column:
    """Number of the kind of a candidate, among the added ones."""
    return F.when(value.rlike(r"@|[\[(]at[\])]"), 0).when(value.rlike("[A-Za-z]"), 1).otherwise(2)


def _sort_of(character: Column) -> Column:
    return (
        F.when(F.length(character) == 0, 0)
        .when(character.rlike(r"\s"), 1)
        .when(character.rlike(r"\p{L}"), 2)
        .when(character.rlike("[0-9]"), 3)
        .when(character.rlike("[\"'(\\[<]"), 4)
        .otherwise(5)
    )


# Format and context of a candidate, each a small number.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "kind": lambda c: _kind(c["value"]),
    "digits": lambda c: _count(c["value"], "0-9", 20),
    "letters": lambda c: F.floor(_count(c["value"], "A-Za-z", 40) / 4),
    "at": lambda c: F.contains(c["value"], F.lit("@")).cast("int"),
    "domain": lambda c: c["value"].rlike(r"(?:@|at[\])])\x20?[A-Za-z0-9-]+\.[A-Za-z]").cast("int"),
    "dots": lambda c: _count(c["value"], ".", 4),
    "plus": lambda c: F.contains(c["value"], F.lit("+")).cast("int"),
    "gaps": lambda c: _count(c["value"], r"\x20()-", 6),
    "seams": lambda c: F.floor(F.least(F.size(F.split(c["value"], SEAMS)) - 1, F.lit(12)) / 2),
    "signs": lambda c: _count(c["value"], "_/=+-", 6),
    "hex": lambda c: c["value"].rlike("^[0-9a-fA-F]+$").cast("int"),
    "luhn": lambda c: (F.length(_digits(c["value"])).between(12, 19) & _luhn(c["value"])).cast("int"),
    "octets": lambda c: c["value"].rlike(VALID_IP).cast("int"),
    "behind": lambda c: _sort_of(c["behind"]),
    "before": lambda c: _sort_of(F.substring(c["before"], -1, 1)),
    "context": lambda c: functools.reduce(
        lambda rest, i: F.when(F.lower(c["before"]).rlike(CONTEXT[i]), i + 1).otherwise(rest),
        reversed(range(len(CONTEXT))),
        F.lit(0),
    ),
}

CANDIDATE = (
    f"struct<start:int,kind:int,end:int,x:struct<{','.join(f'{name}:int' for name in FEATURES)}>,label:boolean,known:boolean>"
)
EXAMPLE = f"struct<x:struct<{','.join(f'{name}:int' for name in FEATURES)}>,label:boolean>"


def _proposed(text: Column) -> Column:
    """Array of the spans that each generator finds for itself; a secret behind a name and an equals sign begins there."""

    def split(span: Column) -> Column:
        def parts(name: Column) -> Column:
            size = F.length(name)
            value = F.struct(
                (span["start"] + size).alias("start"),
                span["end"].alias("end"),
                F.substr(span["value"], size + 1, F.length(span["value"])).alias("value"),
                F.substring(F.concat(span["before"], name), -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
                span["behind"].alias("behind"),
            )
            # A name that could be a secret itself stays as well.
            return (
                F.when(size == 0, F.array(span)).when(name.rlike(f"^{SECRET_LIKE}"), F.array(span, value)).otherwise(F.array(value))
            )

        return _let(F.regexp_extract(span["value"], NAMED_SECRET, 1), parts)

    secrets = F.filter(_matches(text, SECRET_LIKE), lambda span: ~span["value"].rlike(NUMBER_ONLY))
    return F.concat(
        F.when(text.rlike(r"@|[\[(]at[\])]"), _matches(text, ADDRESS_LIKE)).otherwise(_none(FOUND)),
        F.flatten(F.transform(secrets, split)),
        _matches(text, NUMBER_LIKE),
    )


def _beside(span: Column, base: Column) -> Column:
    """Letters and digits of a span outside the base spans that it meets."""

    def letters(first: Column, end: Column) -> Column:
        part = F.substr(span["value"], first - span["start"] + 1, F.greatest(end - first, F.lit(0)))
        return F.length(F.regexp_replace(part, r"[^\p{L}0-9]+", ""))

    def passed(sum_: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(sum_["reached"], F.least(b["end"], span["end"])).alias("reached"),
            (sum_["count"] + letters(sum_["reached"], b["start"])).alias("count"),
        )

    start = F.struct(span["start"].alias("reached"), F.lit(0).alias("count"))
    return F.aggregate(base, start, passed, lambda sum_: sum_["count"] + letters(sum_["reached"], span["end"]))


def _luhn(value: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", _digits(value)), F.lit(False))


def _label(span: Column, kind: Column, holds: Column, covered: Column) -> Column:
    """Whether a candidate is personal data; null if no rule decides."""
    value, before = span["value"], F.lower(span["before"])
    domain = F.regexp_extract(value, r"@\x20?([A-Za-z0-9.-]+)$", 1)
    no_address = (F.length(domain) > 0) & (~F.contains(domain, F.lit(".")) | domain.rlike("^[0-9.-]+$"))
    digits = F.length(_digits(value))
    no_number = (
        (digits < 7)
        | (digits > 19)
        | value.rlike(DATE)
        | value.rlike(QUANTITY)
        | (value.rlike(CARD_LIKE) & ~_luhn(value))
        | (value.rlike(DOTTED) & ~value.rlike(VALID_IP))
    )
    no_secret = before.rlike(DIGEST_CONTEXT) | value.rlike(WORDS_AND_NUMBERS)
    return (
        F.when(kind == 1, F.when(before.rlike(SECRET_CONTEXT), True).when(no_secret, False))
        .when(kind == 0, F.when(holds, True).when(no_address, False))
        .otherwise(F.when(covered, True).when(no_number, False))
    )


def _features(span: Column) -> Column:
    return F.struct(*[make(span).cast("int").alias(name) for name, make in FEATURES.items()])


def _judged(text: Column, base: Column, make: Callable[..., Column], none: Column) -> Column:
    """Array of `make(span, kind, label, covered)` of what the generators propose."""
    text = F.coalesce(text, F.lit(""))

    def judged(span: Column, base: Column) -> Column:
        kind = _kind(span["value"])

        def against(met: Column) -> Column:
            holds = F.size(met) > 0
            covered = holds & (F.when(holds, _beside(span, met)).otherwise(1) == 0)
            return make(span, kind, _label(span, kind, holds, covered), covered)

        return _let(F.filter(base, lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"])), against)

    # The base spans are an argument once, not an expression in every candidate.
    found = _let(
        F.struct(_proposed(text).alias("spans"), base.alias("base")),
        lambda both: F.transform(both["spans"], lambda span: judged(span, both["base"])),
    )
    # Without a digit or an at sign there is nothing to propose.
    return F.when(text.rlike(r"[0-9@]|[\[(]at[\])]"), found).otherwise(none)


def candidates(text: Column, base: Column) -> Column:
    """Array of what the generators propose: start, end, number of the kind, features, label, and whether base spans cover it.

    Candidates may overlap each other. An address is personal data if it holds a
    base span, a number if base spans cover it but for signs between, a secret
    by its context, as no base kind covers secrets. The label is false for what
    is certainly none, and null where no rule decides.
    """

    def candidate(span: Column, kind: Column, label: Column, covered: Column) -> Column:
        return F.struct(
            span["start"].alias("start"),
            (kind + len(KINDS)).alias("kind"),
            span["end"].alias("end"),
            _features(span).alias("x"),
            label.alias("label"),
            covered.alias("known"),
        )

    return _judged(text, base, candidate, _none(CANDIDATE))


def _rewritten(span: Column, kind: Column) -> Column:
    """Array of (value, before, label) of a span of personal data in other formats, and in ones that make it none."""
    value, before = span["value"], span["before"]

    def form(value: Column, label: bool, before: Column = before) -> Column:
        return F.struct(value.alias("value"), before.alias("before"), F.lit(label).alias("label"))

    digits = _digits(value)
    wrong = F.concat(
        F.substr(digits, F.lit(1), F.length(digits) - 1), F.pmod(F.substring(digits, -1, 1).cast("int") + 1, F.lit(10)).cast("string")
    )
    # The shortest address of the same sort.
    short = F.regexp_replace(value, r"^([A-Za-z]++)[^@]*+@(?:[A-Za-z0-9-]+\.)*([A-Za-z0-9-]+\.[A-Za-z0-9-]+)$", "$1@$2")
    address = F.array(
        *[form(F.regexp_replace(v, "\x20?@\x20?", sign), True) for v in (value, short) for sign in (" [at] ", " @ ")],
        form(F.regexp_replace(value, r"(?<=@)([A-Za-z0-9-]++).*$", "$1"), False),
        form(F.concat(F.substring_index(value, "@", 1), F.lit("@"), F.translate(F.substring_index(value, "@", -1), ".", "-")), False),
    )
    some = (F.pmod(F.xxhash64(value), F.lit(8)) + 1).cast("int")
    # The same secret in the letters of other sorts of keys.
    other = F.translate(value, "abcdef2468", "qKvXzmRtWy")
    secret = F.array(
        form(other, True),
        form(F.upper(F.substring(F.translate(value, "abcdef0123468", "qKvXzmRtWyGHJ"), 1, 20)), True),
        form(value, False, F.concat(F.lit("commit "), F.substring(before, -1, 1))),
        form(F.regexp_replace(value, SEAMS, "-"), False),
        *[
            form(F.concat(F.regexp_replace(value, "[0-9]+", sign), F.lit(f"{sign}v"), F.substr(digits, F.lit(1), some)), False)
            for sign in "-/"
        ],
    )

    def date(sign: str) -> Column:
        pieces = [F.lit("20"), F.substring(digits, -2, 2), F.lit(f"{sign}0"), F.substring(digits, -3, 1)]
        return F.concat(*pieces, F.lit(f"{sign}1"), F.substring(digits, -4, 1))

    grouped = F.concat_ws(" ", F.substring(digits, 1, 1), F.substring(digits, 2, 3), F.substring(digits, 5, 3))
    national = F.concat_ws(" ", F.concat(F.lit("0"), F.substring(digits, 2, 2)), F.substring(digits, 4, 4), F.substring(digits, 8, 4))
    phone = F.array(
        form(national, True),
        form(F.regexp_replace(value, r"^\+[0-9]{1,3}\x20?", ""), True),
        form(F.regexp_replace(F.regexp_replace(value, "^\\+", ""), "[^0-9]+", " "), True),
        form(date("-"), False),
        form(date("."), False),
        form(grouped, False),
    )
    machine = F.array(form(F.regexp_replace(value, "^[0-9]+", "999"), False))
    card = F.array(
        form(F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1."), True),
        form(wrong, False),
        form(F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1."), False),
    )
    return (
        F.when(kind == 0, address)
        .when(kind == 1, secret)
        .when(F.contains(value, F.lit("+")), phone)
        .when(value.rlike(VALID_IP), machine)
        .otherwise(card)
    )


def examples(text: Column, base: Column) -> Column:
    """Array of (x, label) to learn from: the candidates that a rule decides, and the rewritten forms of personal data.

    Half of what is personal data, by a hash of its value, is seen without its context.
    """

    def example(span: Column, before: Column, value: Column, label: Column) -> Column:
        seen = F.struct(value.alias("value"), before.alias("before"), span["behind"].alias("behind"))
        hidden = label & (F.pmod(F.xxhash64(value), F.lit(2)) == 1)
        return F.struct(
            _let(seen, lambda seen: _features(seen).withField("context", F.when(hidden, 0).otherwise(FEATURES["context"](seen)).cast("int"))).alias("x"),
            label.alias("label"),
        )

    def learned(span: Column, kind: Column, label: Column, covered: Column) -> Column:
        def of(label: Column) -> Column:
            own = F.array(F.struct(span["value"].alias("value"), span["before"].alias("before"), label.alias("label")))
            forms = F.when(label.isNull(), F.slice(own, 1, 0)).when(label, F.concat(own, _rewritten(span, kind))).otherwise(own)
            return F.transform(forms, lambda f: example(span, f["before"], f["value"], f["label"]))

        return _let(label, of)

    return F.flatten(_judged(text, base, learned, F.expr("cast(array() as array<array<" + EXAMPLE + ">>)")))


@dataclass(frozen=True)
class Selector:
    """The boosted models as an expression on a candidate's features, and the margins from which they select each added kind."""

    margin: Callable[[Column], Column]
    thresholds: dict[int, float]

    def selects(self, x: Column) -> Column:
        """Whether the margin of such features reaches the threshold of their kind."""
        least = functools.reduce(
            lambda rest, kind: F.when(x["kind"] == kind, self.thresholds[kind]).otherwise(rest), self.thresholds, F.lit(float("inf"))
        )
        return self.margin(x) >= least


def _tree(lines: list[str], x: Column) -> Column:
    """The expression of one tree, from its description: If and Else lines, one per split, and Predict lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    feature, threshold = re.search(r"feature (\d+) <= (\S+?)\)", line).groups()
    left = _tree(lines, x)
    lines.pop(0)
    right = _tree(lines, x)
    return F.when(x[list(FEATURES)[int(feature)]] <= float(threshold), left).otherwise(right)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Selector | None:
    """Boosted trees and a threshold for each added kind, from all its examples in the corpus; None if no kind has both sorts.

    Half of the documents, by a hash of the text, train the trees, the others
    calibrate: a kind's threshold is the lowest margin from which on enough of
    its examples are personal data; a kind without one is not selected.
    """
    text = F.col("text")
    found = docs.select(
        F.explode(examples(text, base_spans(text))).alias("c"), (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("trains")
    )
    counted = stage(
        found.groupBy("c.x", "c.label", "trains").agg(F.count("*").cast("double").alias("weight")).select("x.*", "*"),
        "pii_candidates",
    )
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        counted.withColumn("target", F.col("label").cast("double"))
    )
    training = ready.where("trains")
    sorts = training.groupBy("kind").agg(F.min("target").alias("least"), F.max("target").alias("most"))
    learner = GBTClassifier(
        labelCol="target",
        weightCol="weight",
        maxIter=settings.trees,
        maxDepth=settings.depth,
        stepSize=settings.rate,
        seed=settings.seed,
    )
    # Each kind by itself: many examples of one do not decide what trees look at in another.
    models = {r["kind"]: learner.fit(training.where(F.col("kind") == r["kind"])) for r in sorts.where("least < most").collect()}
    if not models:
        return None

    def margin(x: Column) -> Column:
        def of(model) -> Column:
            trees = [
                _tree(tree.toDebugString.strip().split("\n")[1:], x) * weight
                for tree, weight in zip(model.trees, model.treeWeights, strict=True)
            ]
            return functools.reduce(operator.add, trees)

        return functools.reduce(
            lambda rest, kind: F.when(x["kind"] == kind, of(models[kind])).otherwise(rest), models, F.lit(float("-inf"))
        )

    # One row per kind and margin: at most as many as the trees have combinations of leaves among the examples.
    falling = Window.partitionBy("kind").orderBy(F.desc("margin")).rowsBetween(Window.unboundedPreceding, 0)
    precise = (
        counted.where(~F.col("trains"))
        .groupBy("kind", margin(F.col("x")).alias("margin"))
        .agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("label"), F.col("weight")).otherwise(0.0)).alias("right"))
        .withColumn("precision", F.sum("right").over(falling) / F.sum("all").over(falling))
        .where((F.col("precision") >= settings.precision) & (F.col("right") > 0))
        .groupBy("kind")
        .agg(F.min("margin").alias("least"))
        .collect()
    )
    return Selector(margin, {r["kind"]: r["least"] for r in precise}) if precise else None


def all_spans(text: Column, base: Column, selector: Selector | None) -> Column:
    """Array of the base spans and the selected candidates beside them, by start, then kind."""
    if selector is None:
        return base
    selected = F.filter(candidates(text, base), lambda c: ~c["known"] & selector.selects(c["x"]))
    added = F.transform(
        selected, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    )
    return F.array_sort(F.concat(base, added))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS + ADDED))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def personal_data(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of every row.

    Places count code points from 0, the end excluded. A null text is an empty
    one and has no spans. Rows stay apart, also when they repeat or have no id;
    other columns are not read. An empty table gives an empty result.
    """
    selector = fit(docs, settings)

    def number_of(kind: int) -> Column:
        return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")

    found = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    found = found.withColumn("every", all_spans(F.col("text"), F.col("base"), selector))
    return found.select(
        "doc_id",
        *[number_of(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("every")).alias("spans"),
        F.size("every").cast("long").alias("n_spans"),
    )


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap or touch are replaced as one."""
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS + ADDED])

    def replace(done: Column, span: Column) -> Column:
        # Spans come by start: one that begins before the last one's end is part of it.
        fresh = span["start"] >= done["end"]
        before = F.substr(text, done["end"] + 1, span["start"] - done["end"])
        return F.struct(
            F.greatest(done["end"], span["end"]).alias("end"),
            F.when(fresh, F.concat(done["text"], before, F.get(names, span["kind"])))
            .otherwise(done["text"])
            .alias("text"),
        )

    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("text"))
    return _let(
        F.aggregate(spans, start, replace),
        lambda done: F.concat(done["text"], F.substr(text, done["end"] + 1, F.length(text))),
    )


def redact(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with every span of personal data replaced by its kind; all rows and columns stay."""
    selector = fit(docs, settings)
    spans = free_name(docs, "_spans")
    text = F.col("text")
    return (
        docs.withColumn(spans, base_spans(text))
        .withColumn(spans, all_spans(text, F.col(spans), selector))
        .withColumn("text", F.when(F.size(spans) > 0, _redacted(text, F.col(spans))).otherwise(text))
        .drop(spans)
    )
