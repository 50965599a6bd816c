"""Operator 2: personal data by candidate generators, boosted trees and calibrated thresholds, in built-in functions.

Strict rules give base spans of email, ip, card and phone, which always stay. High-recall generators propose further
spans that may overlap: addresses with bracketed words for their signs, telephone numbers without a plus, any dotted
quadruple and quadruples with bracketed dots, any long digit run and groups of digits parted by other signs. A candidate's silver label is evidence that no feature shows: an address is well formed once spelled out, octets
are in range, check digits hold, a number has a country code or a cue word (telephone, call, ...) before it. Format and context features feed gradient
boosted trees, fitted on a bounded sample of candidates with even hashes (``SAMPLE`` by hash). The trees become one SQL expression, so every candidate is scored inside its own
row and no text is shuffled. Only candidates that overlap no base span can be added, so thresholds look at those alone, and only at the ones with odd
hashes, which the trees have not seen: per kind the least score bin from which on their silver precision reaches ``PRECISION``, above the first bin that is
mostly wrong. What is above it is added, the best of overlapping ones first; a kind without such candidates gets nothing.

Runs of digits with separators are found after separators that do not stand between digits are overwritten with
letters, one for one, which keeps offsets and needs no nested repetition.

Defined results: null or empty texts have no spans; repeated rows repeat; an empty table gives an empty table; if all
candidates have one silver label, or there are none, nothing is added to the base spans; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import free_name, materialise, table, whole_text
from spanloom.llm.spans import any_case, count_kind, digest_text, matches

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
TREES, DEPTH = 12, 4
PRECISION = 0.97
BINS = 50
NEAR = 24

# A run is entered at its start, or where the last match ended: the same matches as without, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # possessive: a repeated group that may give back is matched by recursion
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
RUN = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:[(\[]at[)\]]|@)\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,8}"
LOOSE_PHONE = r"[+(]?[0-9][\x20().0-9-]{5,30}[0-9]"
LOOSE_IP = r"(?<![0-9])[0-9]{1,3}(?:\x20?[(\[](?:dot|\.)[)\]]\x20?[0-9]{1,3}){3}(?![0-9])"
LOOSE_CARD = r"(?<![0-9])[0-9]{4}(?:[._/]\x20?|\x20?[-\x20]\x20?)[0-9]{4}(?:[._/]\x20?|\x20?[-\x20]\x20?)[0-9]{4}(?:[._/]\x20?|\x20?[-\x20]\x20?)[0-9]{3,7}(?![0-9])"
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
PHONE_CUES = "|".join(any_case(w) for w in ("tel", "phone", "call", "fax", "mobil"))
CUES = "|".join(any_case(w) for w in ("mail", "contact", "card", "visa", "credit", "carte", "tarjeta", "karte", "addr", "host", "server", "ip"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the mod-10 check."""
    doubled = F.transform(F.filter(F.split(F.reverse(digits_of(value)), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def runs(text: Column) -> Column:
    """Digit runs with single separators, as ``matches``."""
    spaced = F.regexp_replace(text, r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "x")
    return F.when(text.rlike(r"[0-9][0-9\x20-]{10,}[0-9]"), matches(spaced, RUN)).otherwise(matches(F.lit(""), RUN))


def n_digits(value: Column) -> Column:
    return F.length(digits_of(value))


def is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike(OCTET))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the strict rules."""
    long_enough = lambda m: (n_digits(m["value"]) >= 12) & (n_digits(m["value"]) <= 19)
    none = matches(F.lit(""), RUN)
    found = (
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        F.filter(matches(text, IP), lambda m: is_ip(m["value"])),
        F.filter(F.filter(runs(text), long_enough), lambda m: luhn(m["value"])),
        F.filter(matches(text, PHONE), lambda m: (n_digits(m["value"]) >= 9) & (n_digits(m["value"]) <= 15)),
    )
    return F.concat(*[_kinded(x, k) for k, x in enumerate(found)])


def _kinded(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def spelled_out(value: Column) -> Column:
    """An address with the bracketed words at and dot written as signs."""
    return F.regexp_replace(F.regexp_replace(value, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")


def candidate_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value, before, after, evident>> of the high-recall generators."""
    none = matches(F.lit(""), RUN)
    card_like = lambda m: (n_digits(m["value"]) >= 12) & (n_digits(m["value"]) <= 19)
    phone_like = lambda m: (n_digits(m["value"]) >= 7) & (n_digits(m["value"]) <= 15)
    octets = lambda v, before: F.forall(F.split(F.regexp_replace(v, r"[^0-9]+", "."), r"\."), lambda p: p.rlike(OCTET))
    found = (
        (0, F.when(text.rlike(r"@|[(\[]at[)\]]"), matches(text, LOOSE_EMAIL)).otherwise(none), lambda v, before: spelled_out(v).rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")),
        (1, matches(text, IP), octets),
        (1, F.when(text.rlike(r"[0-9]\x20?[(\[](?:dot|\.)[)\]]"), matches(text, LOOSE_IP)).otherwise(none), octets),
        (2, F.filter(runs(text), card_like), lambda v, before: luhn(v)),
        (2, F.when(text.rlike(r"[0-9]{4}(?:[._/]|\x20-|-\x20)\x20?[0-9]{4}"), F.filter(matches(text, LOOSE_CARD), card_like)).otherwise(none), lambda v, before: luhn(v)),
        (3, F.when(text.rlike(r"[0-9][\x20().0-9-]{5,}[0-9]"), F.filter(matches(text, LOOSE_PHONE), phone_like)).otherwise(none), lambda v, before: (v.startswith("+") & (n_digits(v) >= 9)) | before.rlike(PHONE_CUES)),
    )

    def shaped(spans: Column, kind: int, rule) -> Column:
        def one(m: Column) -> Column:
            begin = F.greatest(m["start"] - NEAR, F.lit(0))
            before = F.substring(text, (begin + 1).cast("int"), (m["start"] - begin).cast("int"))
            return F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
                before.alias("before"), F.substring(text, (m["end"] + 1).cast("int"), F.lit(2)).alias("after"), rule(m["value"], before).alias("evident"),
            )

        return F.transform(spans, one)

    return F.concat(*[shaped(x, k, rule) for k, x, rule in found])


def features(c: Column) -> list[Column]:
    """Format and context of a candidate struct, as doubles."""
    v, before, after = c["value"], c["before"], c["after"]
    count = lambda p: F.length(v) - F.length(F.regexp_replace(v, p, ""))
    groups = F.split(F.regexp_replace(v, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    flags = [before.rlike(CUES), before.rlike("[A-Za-z0-9]$"), before.rlike(r"\s$"), before.rlike("[0-9]"), before == "", after.rlike("^[A-Za-z0-9]"), after.rlike(r"^[.,;:!?]"), after.rlike("^[-/=_]"), v.rlike("^[0(]"), F.contains(v, F.lit("  "))]
    values = [
        *[(c["kind"] == k) for k in range(len(KINDS))], F.length(v), count("[0-9]"), count("[A-Za-z]"), count(r"[\x20-]"), count(r"\."), count("[()]"), F.size(groups), F.array_max(F.transform(groups, lambda g: F.length(g))),
        F.length(F.element_at(groups, 1)), F.length(F.element_at(groups, -1)), F.size(F.array_distinct(F.split(digits_of(v), ""))), *flags,
    ]
    return [x.cast("double") for x in values]


def tree_expression(node, get) -> Column:
    """A fitted tree's prediction as nested CASE; ``get(i)`` is feature i."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(get(split.featureIndex()) <= float(split.threshold()), tree_expression(node.leftChild(), get)).otherwise(tree_expression(node.rightChild(), get))


class Scorer:
    """Boosted trees as a SQL expression, and the threshold of each kind (above 1: add nothing)."""

    def __init__(self, model, thresholds: list[float]) -> None:
        self.model, self.thresholds = model, thresholds

    def probability(self, x: Column) -> Column:
        """Score of a feature array."""
        get = lambda i: F.element_at(x, i + 1)
        total = F.lit(0.0)
        for tree, weight in zip(self.model.trees, self.model.treeWeights):
            total = total + F.lit(float(weight)) * tree_expression(tree._call_java("rootNode"), get)
        return 1.0 / (1.0 + F.exp(-2.0 * total))


def fit(docs: DataFrame) -> Scorer | None:
    """Trees from a bounded sample of one half of the candidates; thresholds from all of the other half that overlap no base span."""
    base = F.filter(base_spans(F.col("text")), lambda s: s.isNotNull())
    rows = docs.select(whole_text().alias("text")).select(base.alias("base"), candidate_spans(F.col("text")).alias("found")).where(F.size("found") > 0)
    rows = rows.select("base", F.inline("found")).withColumn("apart", ~F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    found = rows.select("kind", "apart", F.col("evident").cast("double").alias("label"), F.array(*features(F.struct("kind", "value", "before", "after"))).alias("x"), F.xxhash64("value", "before", "after").alias("h"))
    found = materialise(found, "pii-candidates")
    sample = found.where("h % 2 = 0").orderBy("h", "kind").limit(SAMPLE)
    sample = materialise(sample.select("label", array_to_vector("x").alias("features")), "pii-sample").coalesce(4)
    if sample.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11).fit(sample)
    scorer = Scorer(model, [2.0] * len(KINDS))
    scored = found.where("apart AND h % 2 <> 0").select("kind", "label", F.least(F.lit(BINS - 1), F.floor(scorer.probability(F.col("x")) * BINS).cast("int")).alias("bin"))
    table_ = {(r["kind"], r["bin"]): (r["good"], r["n"]) for r in scored.groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()}  # kinds x BINS rows
    for kind in range(len(KINDS)):
        good = n = 0
        for b in reversed(range(BINS)):
            g, m = table_.get((kind, b), (0, 0))
            if m and g / m < 0.5:  # from here down a candidate is likelier wrong than right
                break
            good, n = good + g, n + m
            if n and good / n >= PRECISION:
                scorer.thresholds[kind] = b / BINS
    return scorer


def added_spans(text: Column, base: Column, scorer: Scorer) -> Column:
    """Candidates at or above their kind's threshold that overlap neither a base span nor a better candidate."""
    limits = F.array(*[F.lit(t) for t in scorer.thresholds])
    apart = lambda c: ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    scored = F.transform(F.filter(candidate_spans(text), apart), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.array(*features(c)).alias("x")))
    scored = F.transform(scored, lambda c: F.struct((-scorer.probability(c["x"])).alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    good = F.array_sort(F.filter(scored, lambda c: -c["order"] >= F.element_at(limits, c["kind"] + 1)))

    def take(acc: Column, c: Column) -> Column:
        met = F.exists(acc, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return F.when(met, acc).otherwise(F.concat(acc, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))

    return F.aggregate(good, base, take, lambda acc: F.slice(acc, F.size(base) + 1, F.greatest(F.size(acc) - F.size(base), F.lit(0))))


def find_pii(docs: DataFrame, scorer: Scorer | None, base: str = "pii_base", added: str = "pii_added") -> DataFrame:
    """``docs`` with ``base`` and ``added``: array<struct<kind, start, end>>."""
    rows = docs.withColumn(base, base_spans(whole_text()))
    if scorer is None:
        return rows.withColumn(added, F.slice(base, 1, 0))
    return rows.withColumn(added, added_spans(whole_text(), F.col(base), scorer))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones merged, replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(F.concat(gap, F.element_at(names, s["kind"] + 1)))).alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["out"].alias("out"))).otherwise(fresh)

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")), step, done))


def redacted(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, if there, brought up to date; null texts stay null."""
    base, added, spans = (free_name(docs.columns, c) for c in ("pii_base", "pii_added", "pii_spans"))
    rows = find_pii(docs, scorer, base, added).withColumn(spans, F.concat(base, added))
    text = F.when(F.size(spans) > 0, redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_pii(docs, fit(docs))
    return rows.select(
        "doc_id", *[count_kind(F.col("pii_base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(digest_text(F.col("pii_base"), KINDS), 256).alias("base_sha256"), digest_text(F.concat("pii_base", "pii_added"), KINDS).alias("spans"), F.size("pii_added").cast("long").alias("n_added"), (F.size("pii_base") + F.size("pii_added")).cast("long").alias("n_spans"),
    )
