"""Personal data: patterns, and information-theoretic sanitisation, in Spark functions only.

Base spans are emails, IP addresses, card and phone numbers, found by pattern and check. The values found are
the protected entities. Around every mention the corpus tells which terms go with it: with T word positions
in the corpus, w(e) of them near mentions of entity e, n(t) occurrences of term t, and n(e,t) of these near e,

    IC(e) = -log2(w(e) / T)        PMI(e;t) = log2((n(e,t) / n(t)) / (w(e) / T))        disclosure = PMI / IC

is the share of the entity's information content that the term gives away, 1 if the term occurs nowhere
else. A term whose disclosure for any entity reaches ``threshold``, in at least ``support`` different contexts,
is sanitised wherever it occurs: generalised to its beginning (``sch*``) if the words that share this do not
disclose the entity themselves, else removed. With ``confidence`` (0.9 unless it is None) a term is also sanitised, however few its
contexts, if its disclosure reaches ``threshold`` with the lower confidence bound (Wilson, one-sided) of
n(e,t) / n(t) in place of that share: the more words a corpus has, the fewer mentions that takes.

A match is marked in the text and the text split at the marks, which gives positions in code points without a
UDF. Patterns are possessive and start at the beginning of a run only, so they take linear time and no stack;
they match what the plain patterns match. Counts cover every word of every document; words are counted in
the task before they are shuffled, and mentions and terms meet by equality only.

Defined cases: a null text is empty; a null doc_id is treated like any other; repeated rows count as often as
they come; spans of different kinds may overlap; a term inside a base span is not reported; an empty table
gives no rows.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope.llm.common import materialize
from wattscope.llm.native import let, running_starts

MARK, NOT_MARK = "\ue000", "\ue001"
LOCAL = "[A-Za-z0-9._%+-]"
# \G: right after the previous match, where a run may be entered in its middle.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain to hold a match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
REMOVED = "[TERM]"
#: Characters beside a mention that are looked at, and words taken of them.
REACH, NEAR_WORDS = 120, 8
NOT_LETTERS = r"\P{L}+"
NO_ID = -(1 << 63)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        x = F.when(i % 2 == 1, 2 * x).otherwise(x)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    return let(_digits(value), lambda d: F.when(F.char_length(d).between(16, 19), _luhn(d)).otherwise(False)
               if kind == "card" else F.char_length(d).between(8, 15))


def _matches(text: Column, pattern: Column | str, keep, kind: str, hint: str | None = None) -> Column:
    """Spans (kind, start, end, value, left, right) of a pattern in ``text``, from where marks split it."""
    clear = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, NOT_MARK)).otherwise(text)
    marked = F.regexp_replace(clear, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    parts = F.split(marked, MARK, -1)

    def spans(ps: Column) -> Column:
        def placed(starts: Column) -> Column:
            rows = F.transform(ps, lambda p, i: F.struct(
                F.lit(kind).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.char_length(p)).alias("end"), p.alias("value"),
                F.right(F.get(ps, i - 1), F.lit(REACH)).alias("left"), F.left(F.coalesce(F.get(ps, i + 1), F.lit("")), F.lit(REACH)).alias("right"),
                i.alias("i")))
            return F.transform(F.filter(rows, lambda r: (r["i"] % 2 == 1) & keep(r["value"])), lambda r: F.struct(
                *(r[c].alias(c) for c in ("kind", "start", "end", "value", "left", "right"))))

        return let(running_starts(F.transform(ps, F.char_length)), placed)

    nothing = F.array().cast(SPANS)
    found = let(parts, lambda ps: F.when(F.size(ps) > 1, spans(ps)).otherwise(nothing))
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(nothing) if hint else found


SPANS = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind and then start, with what stands beside them."""
    return F.concat(*(_matches(text, p, lambda v, kind=kind: _valid(kind, v), kind, HINTS[kind]) for kind, p in PATTERNS.items()))


def _terms(text: Column) -> Column:
    """Letter runs of three letters at least, in lower case."""
    return F.filter(F.split(F.lower(text), NOT_LETTERS), lambda w: F.char_length(w) >= 3)


def _near(span: Column) -> Column:
    """Distinct terms beside a mention; a word that the reach cuts is left out."""
    left = F.when(F.char_length(span["left"]) == REACH, F.regexp_replace(span["left"], r"^\p{L}+", "")).otherwise(span["left"])
    right = F.when(F.char_length(span["right"]) == REACH, F.regexp_replace(span["right"], r"\p{L}+$", "")).otherwise(span["right"])
    last = lambda a: F.when(F.size(a) > NEAR_WORDS, F.slice(a, -NEAR_WORDS, NEAR_WORDS)).otherwise(a)
    return F.array_distinct(F.concat(let(_terms(left), last), F.slice(_terms(right), 1, NEAR_WORDS)))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _lower_bound(share: Column, n: Column, confidence: float) -> Column:
    z = NormalDist().inv_cdf(confidence)
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_terms(docs: DataFrame, threshold: float = 0.9, support: int = 3, confidence: float | None = 0.9) -> DataFrame:
    """``term, disclosure, replacement`` of the terms that disclose a protected entity of the corpus."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select(F.explode(base_spans(text)).alias("s"))
    mentions = materialize(spans.select(_entity(F.col("s")).alias("entity"), F.xxhash64("s.left", "s.right").alias("context"),
                                        _near(F.col("s")).alias("terms")).where(F.size("terms") > 0), "mentions")
    entities = mentions.groupBy("entity").agg(F.sum(F.size("terms")).alias("w"))
    pairs = (mentions.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts")))
    vocabulary = materialize(docs.select(F.explode(_terms(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "vocabulary")
    total = vocabulary.agg(F.sum("n_t")).first()[0] or 1

    def disclosure(n_et: Column, n_t: Column, confidence: float | None = None) -> Column:
        ic = -F.log2(F.col("w") / total)
        # An entity that is beside every word of the corpus has no information to give away.
        share = F.least(n_et / n_t, F.lit(1.0))
        share = share if confidence is None else _lower_bound(share, n_t.cast("double"), confidence)
        return F.when(ic > 0, 1 + F.log2(share) / ic).otherwise(0.0)

    enough = F.col("contexts") >= support
    if confidence is not None:
        enough = enough | (disclosure(F.col("n"), F.col("n_t"), confidence) >= threshold)
    risky = ((pairs if confidence is not None else pairs.where(enough)).join(vocabulary, "term").join(entities, "entity")
             .withColumn("disclosure", disclosure(F.col("n"), F.col("n_t"))).where(enough & (F.col("disclosure") >= threshold))
             .withColumn("start", F.left("term", F.lit(3))).select("entity", "term", "w", "disclosure", "start"))
    wide = vocabulary.groupBy(F.left("term", F.lit(3)).alias("start")).agg(F.sum("n_t").alias("n_start"))
    wide_near = pairs.groupBy("entity", F.left("term", F.lit(3)).alias("start")).agg(F.sum("n").alias("n_near"))
    still = disclosure(F.col("n_near"), F.col("n_start")) >= threshold
    return (risky.join(wide, "start").join(wide_near, ["entity", "start"]).groupBy("term")
            .agg(F.max("disclosure").alias("disclosure"), F.max(still | (F.char_length("term") <= 3)).alias("remove"), F.min("start").alias("start"))
            .select("term", "disclosure", F.when(F.col("remove"), REMOVED).otherwise(F.concat("start", F.lit("*"))).alias("replacement")))


def find(docs: DataFrame, name: str = "pii", **how) -> DataFrame:
    """``docs`` with ``name`` behind all other columns (one of that name gives way): array of (kind, start, end, replacement), by kind (email, ip, card, phone, term)
    and start; positions in code points, end exclusive. ``how``: see ``disclosing_terms``."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    terms = materialize(disclosing_terms(docs, **how), "terms")
    # By the text too, or all rows without doc_id would be one group.
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k1"), F.xxhash64("text").alias("_k2")]
    own = (docs.select(*keys, F.explode(F.array_distinct(_terms(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
           .join(terms, "term").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("term", "replacement")).alias("_terms")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.col("_terms.term"), "|"), F.lit(r")(?!\p{L})"))
    replacement = F.map_from_entries("_terms")

    def all_spans(base: Column) -> Column:
        short = lambda s, r: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), r.alias("replacement"))
        labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
        free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        added = F.when(F.col("_terms").isNotNull(), F.transform(
            F.filter(_matches(text, pattern, lambda v: F.lit(True), "term"), free),
            lambda s: short(s, F.coalesce(F.try_element_at(replacement, F.lower(s["value"])), F.lit(REMOVED)))))
        named = F.transform(base, lambda s: short(s, F.element_at(labels, s["kind"])))
        return F.concat(named, F.coalesce(added, F.array().cast("array<struct<kind:string,start:int,end:int,replacement:string>>")))

    # As one column, so that no name of a document's column meets one of these.
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns if c.lower() != name.lower())).alias("doc"), *keys)
    return (whole.join(own, ["_k1", "_k2"], "left").select(F.col("doc").withField(name, let(base_spans(text), all_spans)).alias("doc"))
            .select("doc.*"))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span's replacement in its place; of overlapping spans the first one's stands for all."""
    text = F.coalesce(text, F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["replacement"].alias("replacement"))))

    def step(a: Column, s: Column) -> Column:
        behind = s["start"] >= a["at"]
        cut = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.greatest(a["at"], -s["back"]).alias("at"),
                        F.when(behind, F.concat(a["out"], F.array(cut, s["replacement"]))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(let(done, lambda d: F.concat(
        F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.char_length(text)))))
