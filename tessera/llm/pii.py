"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

DataFrame functions and Spark ML only.  Four strict patterns give the base spans.
Two generators of high recall propose further, overlapping spans: any run of
digits with the usual separators (as ip, card or phone) and any address with a
written-out or spaced sign (as email).  A gradient-boosted tree classifier learns
from the base spans what such data look like; its features are format and context
only, not the checks that make a base span valid, so that look-alikes which the
strict patterns miss can score high.  It learns from all candidates that are not held out.  For
each kind the threshold is the lowest that keeps the wanted precision on all
held-out candidates; where none does, nothing is added.

Every text is cut at the matches of each pattern, so a span's start is the running
sum of the pieces before it; the documents' text is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The kinds in their order, and the pattern of each. Possessive repeats and the look-behinds change no
#: match; they keep long runs of word characters or digits from being tried at every position.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: what they may propose, and their patterns.
WIDE = {
    "digits": (("ip", "card", "phone"), r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+"),
    "address": (("email",), r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}+"
                            r"(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[a-z0-9-]{1,63}+){1,5}"),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CONTEXT = 24
#: Words before a span that speak for a kind of data.
_WORDS = {"calls": r"(?i)tel|phone|call|fax|mobil|whatsapp|sms", "mails": r"(?i)mail|contact|write|kontakt",
          "pays": r"(?i)card|visa|master|amex|credit|iban|konto|account|pay", "hosts": r"(?i)\bip\b|host|server|addr|ping"}


def _pieces(source: str, pattern: str) -> Column:
    """(source, nth, gap, hit, before, after) for the matches of a pattern in ``text``."""
    cut = F.col(f"_cut_{source}")
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda hit, i: F.struct(
        F.lit(source).alias("source"), i.alias("nth"), F.char_length(F.get(cut, i)).alias("gap"), hit.alias("hit"),
        F.right(F.get(cut, i), F.lit(_CONTEXT)).alias("before"), F.left(F.get(cut, i + 1), F.lit(_CONTEXT)).alias("after")))


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def one(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), one) % 10 == 0


def _valid() -> Column:
    """Whether a match of a base pattern passes its check."""
    hit, source = F.col("hit"), F.col("source")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    return (F.when(source == "email", True)
            .when(source == "ip", hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(source == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
            .when(source == "phone", n.between(10, 15)).otherwise(False))


def _features() -> dict[str, Column]:
    """Format and context of a candidate; no sign that decides whether it is a base span, as a country's code does."""
    before, after = F.col("before"), F.col("after")
    hit = F.regexp_replace("hit", r"^\+[0-9]{1,3}[\x20.-]+(?=[0-9(])|^\+[0-9]{1,3}(?=\()", "")

    def count(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(hit, f"[^{pattern}]", "")).cast("double")
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.char_length(g))
    size = F.coalesce(F.array_max(sizes), F.lit(0))
    ends = F.right(before, F.lit(1))
    out = {"n_digits": count("0-9"), "n_letters": count("A-Za-z"), "n_dots": count("."), "n_hyphens": count("-"),
           "n_spaces": count(r"\x20"), "n_brackets": count("()"), "n_groups": F.size(groups).cast("double"),
           "longest": size.cast("double"), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
           "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)).cast("double"),
           "last": F.coalesce(F.element_at(F.when(F.size(sizes) > 0, sizes), -1), F.lit(0)).cast("double"),
           "after_word": ends.rlike(r"[\p{L}\p{N}_]").cast("double"), "after_equals": ends.isin("=", ":", "#", "\"").cast("double"),
           "after_line": ((before == "") | ends.rlike(r"\s")).cast("double"),
           "before_word": F.left(after, F.lit(1)).rlike(r"[\p{L}\p{N}_]").cast("double")}
    out |= {name: before.rlike(words).cast("double") for name, words in _WORDS.items()}
    out |= {f"as_{kind}": (F.col("kind") == kind).cast("double") for kind in KINDS}
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}


def _candidates(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all documents, and (row, kind, start, end, base, failed, hit, before, after) of all spans.

    ``base``: a match of the kind's pattern that passes its check; ``failed``: one that does not; neither: a candidate.
    """
    patterns = BASE | {name: p for name, (_, p) in WIDE.items()}
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Texts without a digit and without a sign for "at" hold nothing that any pattern finds.
    seen = F.col("text").rlike(r"[0-9@]|(?i)[\(\[{]at[\)\]}]")
    cut = text.withColumns({f"_cut_{k}": F.when(seen, F.split("text", p, -1)) for k, p in patterns.items()})
    spans = F.when(seen, F.concat(*[_pieces(k, p) for k, p in patterns.items()]))
    rows = scratch.write(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", spans.alias("spans")), "matches")
    flat = (rows.where("spans is not null").select("row", F.explode("spans").alias("s")).select("row", "s.*").repartition("row"))
    along = Window.partitionBy("row", "source").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("hit")
    flat = flat.withColumn("end", F.sum(F.col("gap") + size).over(along)).withColumn("start", F.col("end") - size)
    kinds = F.create_map(*[x for k in patterns for x in (
        F.lit(k), F.array(*map(F.lit, WIDE[k][0] if k in WIDE else (k,))))])
    flat = (flat.withColumn("strict", F.col("source").isin(*BASE)).withColumn("valid", _valid())
            .withColumn("kind", F.explode(F.element_at(kinds, F.col("source"))))
            .withColumn("base", F.col("strict") & F.col("valid")).withColumn("failed", F.col("strict") & ~F.col("valid")))
    return rows.select("row", "doc_id"), flat.select("row", "kind", "start", "end", "base", "failed", "hit", "before", "after")


#: Thresholds lie on a grid of this many steps, so what the driver sees of the held-out candidates is bounded.
STEPS = 10_000


def _probability() -> Column:
    return vector_to_array("probability")[1]


def _train(spans: DataFrame, scratch: Scratch, precision: float, least: int):
    """(assembler, model, threshold by kind) fitted on all candidates, or None without both classes.

    Candidates of equal features are one row weighted by their number.  Held out, a
    candidate that is a base span counts as right and one that fails its kind's
    check as wrong.  One that no strict pattern reads is neither: it counts as right
    by its score over the mean score of the base spans, as is usual in learning from
    positive and unlabelled data.
    """
    names = list(_features())
    same = Window.partitionBy("row", "kind", "end")
    marked = (spans.withColumn("label", F.max(F.col("base").cast("double")).over(same))
              .withColumn("wrong", F.max("failed").over(same) & (F.col("label") == 0)).where("not base and not failed"))
    fold = F.pmod(F.xxhash64("row", "start"), F.lit(1000))
    alike = (marked.select("label", "wrong", "kind", (fold < 300).alias("held"), *(c.alias(n) for n, c in _features().items()))
             .groupBy("label", "wrong", "kind", "held", *names).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    alike = scratch.write(assembler.transform(alike).select(
        "label", "wrong", "kind", "held", "weight", "features"), "candidates")
    fit = alike.where("not held")
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=5, weightCol="weight").fit(fit)
    w, p = F.col("weight"), _probability()
    steps = (model.transform(alike.where("held")).groupBy("kind", F.floor(p * STEPS).alias("step"))
             .agg(F.sum(w).alias("n"), F.sum(w * F.col("label")).alias("base"), F.sum(w * F.col("label") * p).alias("p_base"),
                  F.sum(F.when((F.col("label") == 0) & ~F.col("wrong"), w)).alias("open"))
             .fillna(0).orderBy(F.desc("step")).collect())
    cuts = {}
    for kind in KINDS:
        mine = [r for r in steps if r.kind == kind]
        mean = sum(r.p_base for r in mine) / max(1, sum(r.base for r in mine))
        good = seen = 0
        for r in mine if mean else ():
            seen, good = seen + r.n, good + r.base + r.open * min(1, r.step / STEPS / mean)
            if seen >= least and good >= precision * seen:
                cuts[kind] = r.step / STEPS
    return assembler, model, cuts


def find_personal_data(docs: DataFrame, *, precision: float = 0.95, least: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are of the base spans, ``spans`` lists base and added spans as
    kind:start:end (code points, end exclusive) by start, then kind.  Added spans
    overlap no base span and no other added span.  Null and empty texts have no
    spans; repeated rows are searched each; without candidates of both classes,
    or where no threshold keeps ``precision`` on at least ``least`` held-out
    candidates, nothing is added; an empty table gives no rows; further columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows, spans = _candidates(docs, scratch)
    trained = _train(spans, scratch, precision, least)
    base = spans.where("base").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    order = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    if trained and trained[2]:
        assembler, model, cuts = trained
        wide = spans.where("not base and not failed").withColumns(_features())
        scored = model.transform(assembler.transform(wide)).withColumn("p", _probability())
        least_p = F.element_at(F.create_map(*[x for k, c in cuts.items() for x in (F.lit(k), F.lit(float(c)))]), F.col("kind"))
        added = (scored.where(F.floor(F.col("p") * STEPS) / STEPS >= least_p)
                 .withColumn("nth", F.row_number().over(Window.partitionBy("row", "start", "end").orderBy(F.desc("p"), "kind")))
                 .where("nth = 1").select("row", "kind", "start", "end", F.lit(False).alias("base")))
        both = base.unionByName(added).repartition("row")
        # An added span stays if no base span and no earlier added span reaches into it.
        line = Window.partitionBy("row").orderBy("start", F.desc("base"), "end")
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        later = line.rowsBetween(1, Window.unboundedFollowing)
        both = (both.withColumn("_e", F.max("end").over(earlier))
                .withColumn("_s", F.min(F.when(F.col("base"), F.col("start"))).over(later))
                .where("base or ((_e is null or _e <= start) and (_s is null or _s >= end))").drop("_e", "_s"))
    else:
        both = base.repartition("row")
    item = F.struct("start", order.alias("k"), "end", "kind")
    found = both.groupBy("row").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("b"), F.sort_array(F.collect_list(item)).alias("s"))

    def joined(c: str) -> Column:
        return F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))
    return rows.join(found, "row", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined("b"), 256).alias("base_sha256"), joined("s").alias("spans"))
