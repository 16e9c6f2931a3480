"""Licence scans: a trained paragraph classifier with a calibrated unknown class, checked by templates. DataFrame operations alone."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reelquery.llm import licence_texts as given

if TYPE_CHECKING:
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.feature import CountVectorizerModel

UNKNOWN = "unknown"
FAMILIES = list(given.TEXTS)
#: Longest n-gram; penalty of weights, and its L1 part, which keeps few n-grams; steps of the fit at most (it needs some 100); every
#: how many-th pair of a name and a wording that grants it, or a sentence that speaks of it, is an example; words of a text's windows.
NGRAM, PENALTY, L1, STEPS, EVERY, SPOKEN, WINDOW = 2, 2e-5, 0.5, 400, 2, 5, 24
#: Least probability of a reported paragraph; least share of a template's words that confirms a family, and that lets
#: another family's template overturn it.
LEAST_PROBABILITY, LEAST_SIMILARITY, OVERTURNING = 0.5, 0.5, 0.9
#: Control characters that mark joined lines and line numbers inside a text; a text's own ones become spaces first.
JOINT, MARK = "\x01", "\x02"
#: What does not count at a line's ends: white space, and comment signs at its beginning.
WHITE, SIGNS = " \t\r\f\x0b", "#*/;%!>|-"


def tokens(text: Column) -> Column:
    """Runs of letters and runs of digits, so that GPL-3.0-only, GPLv3 and GPL 3 share theirs."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def windows(text: str) -> list[str]:
    """A text, and its windows of WINDOW words, half overlapping: notices are quoted in part, or wrapped."""
    words = text.split()
    return [text] + [" ".join(words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW // 2, WINDOW // 2) if len(words) > WINDOW]


def examples() -> list[tuple[str, str, float]]:
    """(family, paragraph, weight) for the fit. Known families and the unknown class weigh the same in sum, and within a family
    its texts and the wordings with its names do."""
    texts = [(family, text) for family, texts in given.TEXTS.items() for whole in texts for text in windows(whole)]
    named = [(family, w.format(name)) for family, names in given.NAMES.items() for i, name in enumerate(names) for j, w in enumerate(given.WORDINGS) if (i + j) % EVERY == 0]
    other = [*given.OTHERS, *(a.format(t) for a in given.AROUND for t in given.THINGS), *(u.format(p) for u in given.UNDER for p in given.PLACES)]
    other += [w.format(name) for i, name in enumerate(given.INVENTED) for j, w in enumerate(given.WORDINGS) if (i + j) % EVERY == 0]
    other += [w.format(name) for i, name in enumerate(x for names in given.NAMES.values() for x in names) for j, w in enumerate(given.SPEAKING) if (i + j) % SPOKEN == 0]
    known = [(f, text, 1 / sum(f == x for x, _ in own)) for own in (texts, named) for f, text in own]
    shares = {f: sum(weight for x, _, weight in known if x == f) for f in FAMILIES}
    return [(f, text, weight / shares[f]) for f, text, weight in known] + [(UNKNOWN, text, len(FAMILIES) / len(other)) for text in other]


def calibration_examples() -> list[tuple[str, str, float]]:
    """The same for calibration, from wordings, licences and sentences that the fit has not seen."""
    known = [(family, w.format(name)) for family, names in given.NAMES.items() for name in names for w in given.CALIBRATION_WORDINGS]
    other = [*given.CALIBRATION_OTHERS, *(w.format(name) for name in given.UNSEEN for w in (*given.WORDINGS, *given.CALIBRATION_WORDINGS))]
    other += [w.format(name) for i, name in enumerate(x for names in given.NAMES.values() for x in names) for j, w in enumerate(given.CALIBRATION_SPEAKING) if (i + j) % SPOKEN == 0]
    return [(f, text, 1 / len(known)) for f, text in known] + [(UNKNOWN, text, 1 / len(other)) for text in other]


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_of(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    values = ", ".join(f"({literal(f)}, {literal(t)}, {w!r}D)" for f, t, w in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(family, text, weight)").coalesce(1)


@dataclass(frozen=True)
class Model:
    """Vocabulary and weights of the classifier, and slope and shift of its calibration."""

    counter: CountVectorizerModel
    regression: LogisticRegressionModel
    slope: float = 1.0
    shift: float = 0.0

def telling_words(model: Model, least_probability: float) -> tuple[str, ...]:
    """Words that every n-gram with a weight for some family above that for unknown holds one of. A paragraph without them
    has the margin of an empty one at most; they are all words if that could be enough."""
    weights, shifts = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    if 1 / (1 + math.exp(-((shifts[:-1] - shifts[-1]).max() * model.slope + model.shift))) >= least_probability:
        return ()
    lifting = [g.split(" ") for g, up in zip(model.counter.vocabulary, (weights[:-1] - weights[-1]).max(0) > 0, strict=True) if up]
    found = {words[0] for words in lifting if len(words) == 1}
    for words in sorted(lifting):
        if not found.intersection(words):
            found.add(max(set(words) - {*given.FUNCTION_WORDS}, key=lambda w: (w.isalpha(), len(w), w)))
    return tuple(sorted(found))


def grams(df: DataFrame) -> DataFrame:
    """df with grams: the n-grams of 1 to NGRAM of its words."""
    from pyspark.ml.feature import NGram

    names = ["words"]
    for n in range(2, NGRAM + 1):
        names.append(f"_grams_{n}")
        df = NGram(n=n, inputCol="words", outputCol=names[-1]).transform(df)
    return df.withColumn("grams", F.concat(*names)).drop(*names[1:])


def scored(df: DataFrame, model: Model) -> DataFrame:
    """df (words) with family, the likeliest of FAMILIES, and probability, that it is this family and not unknown.

    The margin between the best family and unknown is calibrated on paragraphs kept out of the fit; what another family
    may claim of it is the softmax among families."""
    from pyspark.ml.functions import vector_to_array

    rows = model.regression.transform(model.counter.transform(grams(df)))
    # through a generator, so that filters on what follows don't repeat the classifier
    rows = rows.select(*df.columns, F.explode(F.array(vector_to_array("rawPrediction"))).alias("_z"))
    known = F.slice("_z", 1, len(FAMILIES))
    rows = rows.withColumn("_top", F.array_max(known)).withColumn("_margin", F.col("_top") - F.element_at("_z", -1))
    share = 1 / F.aggregate(known, F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(known, F.col("_top")).cast("int"))
    probability = share / (1 + F.exp(-(F.col("_margin") * model.slope + model.shift)))
    return rows.select(*df.columns, family.alias("family"), probability.alias("probability"), F.col("_margin").alias("margin"))


def train(spark: SparkSession) -> Model:
    """A multinomial logistic regression on binary n-grams, and the Platt step of its margin: what was right of the
    calibration examples against what was wrong or is of unknown licence."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, VectorAssembler

    label = F.array_position(F.array(*map(F.lit, [*FAMILIES, UNKNOWN])), F.col("family")).cast("double") - 1
    rows = grams(table_of(spark, examples()).select(label.alias("label"), "weight", tokens(F.col("text")).alias("words")))
    empty = f"^(?:(?:{'|'.join(given.FUNCTION_WORDS)}|[0-9]+)(?: |$))+$"
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(rows.withColumn("grams", F.filter("grams", lambda g: ~g.rlike(empty))))
    settings = {"labelCol": "label", "weightCol": "weight", "standardization": False}
    fitted = LogisticRegression(regParam=PENALTY, elasticNetParam=L1, maxIter=STEPS, family="multinomial", **settings).fit(counter.transform(rows)).setProbabilityCol("")
    model = Model(counter, fitted)
    held = scored(table_of(spark, calibration_examples()).select(F.col("family").alias("truth"), "weight", tokens(F.col("text")).alias("words")), model)
    held = held.select((F.col("family") == F.col("truth")).cast("double").alias("label"), "weight", "margin")
    held = VectorAssembler(inputCols=["margin"], outputCol="features").transform(held)
    step = LogisticRegression(regParam=1e-4, maxIter=60, **settings).fit(held)
    return Model(counter, fitted, float(step.coefficients[0]), float(step.intercept))


@lru_cache(maxsize=1)
def trained(spark: SparkSession, application: str) -> Model:
    """The model, fitted once an application: the examples are always the same."""
    return train(spark)


def templates() -> Column:
    """Names and texts of all families as sorted distinct words, in an array: a constant."""
    rows = [{"family": family, "text": text, "name": table is given.NAMES} for table in (given.NAMES, given.TEXTS) for family, texts in table.items() for text in texts]
    raw = F.from_json(F.lit(json.dumps(rows)), "array<struct<family: string, text: string, name: boolean>>")
    return F.transform(raw, lambda t: F.struct(t["family"].alias("family"), F.array_distinct(tokens(t["text"])).alias("words"), t["name"].alias("name")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """text_id, doc_id, run, paragraph, n_lines, line: every line, and every run of lines of one wrapped paragraph as one.

    Between blank lines, a line goes on in the next one if that one's first word would not have fitted on it, in a block as
    wide as its longest line. Comment marks at a line's begin do not count; a line of nothing else is blank. All of it stays
    within a row: nothing is shuffled."""
    plain = F.translate(F.col("text"), JOINT + MARK, "  ")
    numbered = F.transform(F.split(plain, "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(MARK), F.rtrim(F.ltrim(x, F.lit(WHITE + SIGNS)), F.lit(WHITE))))
    blocks = F.split(F.array_join(numbered, "\n"), f"(?:^|\n)[0-9]+{MARK}(?=\n|$)")
    rows = docs.select(F.monotonically_increasing_id().alias("text_id"), "doc_id", F.explode(blocks).alias("block")).where("block <> ''")
    rows = rows.withColumn("own", F.filter(F.split("block", "\n"), lambda x: x != ""))
    rows = rows.withColumn("sizes", F.transform("own", lambda x: F.length(x) - F.instr(x, MARK)))
    rows = rows.withColumn("wide", F.array_max("sizes"))

    def following(x: Column, i: Column) -> Column:
        first = F.length(F.substring_index(x, " ", 1)) - F.instr(x, MARK)
        return F.when((i > 0) & (F.get("sizes", i - 1) + 1 + first > F.col("wide")), JOINT).otherwise("\n")

    runs = F.split(F.array_join(F.transform("own", lambda x, i: F.concat(following(x, i), x)), ""), "\n")
    rows = rows.select("text_id", "doc_id", F.explode(F.filter(runs, lambda x: x != "")).alias("run"))
    lines = F.split("run", JOINT)
    units = F.when(F.size(lines) > 1, F.array_append(lines, F.col("run"))).otherwise(lines)
    rows = rows.select("text_id", "doc_id", F.substring_index("run", MARK, 1).cast("int").alias("run"), F.explode(units).alias("unit"))
    number = F.substring_index("unit", MARK, 1).cast("int").alias("paragraph")
    return rows.select("text_id", "doc_id", "run", number, F.size(F.split("unit", JOINT)).alias("n_lines"), F.regexp_replace("unit", f"(?:^|{JOINT})[0-9]+{MARK}", " ").alias("line"))


def scan(docs: DataFrame, least_probability: float = LEAST_PROBABILITY, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """A row per paragraph with a licence: doc_id, paragraph (its first line, from 0), family, probability, similarity, confirmed.
    A paragraph is a line, or the lines of a wrapped one where these together match more of a template than each alone.

    Every line of every text is classified; the weights themselves say which words a paragraph needs one of to be of a known
    family, so only paragraphs with such a word are taken apart further. Paragraphs whose calibrated probability is below least_probability are of
    unknown licence and left out. The predicted family is then compared with the templates (names and texts of all
    families): similarity is the largest share of a template of the family whose words the paragraph has, and confirmed says
    that it reaches least_similarity. A name counts only as a whole, and only in a paragraph with a word of granting. A template of another family overturns the prediction if the paragraph has nearly
    all its words and these are more than any such template of the predicted family has.

    Null and empty texts have no paragraphs; a text of any length is scanned whole; rows without doc_id and repeated rows
    are scanned each; ties go to the family first in FAMILIES; an empty table gives no rows; extra columns are ignored."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    units = paragraphs(texts).withColumn("words", tokens(F.col("line"))).drop("line")
    model = trained(docs.sparkSession, docs.sparkSession.sparkContext.applicationId)
    telling = telling_words(model, least_probability)
    found = scored(units.where(F.arrays_overlap("words", F.array(*map(F.lit, telling)))) if telling else units, model).where(F.col("probability") >= least_probability)
    hit = lambda t: F.size(F.array_intersect(t["words"], F.col("words")))
    found = found.withColumn("_grants", F.arrays_overlap("words", F.array(*map(F.lit, given.GRANTING))))
    whole = lambda t: (hit(t) == F.size(t["words"])) & F.col("_grants")
    share = lambda t: F.when(t["name"], whole(t).cast("double")).otherwise(hit(t) / F.size(t["words"]))
    compared = F.transform(templates(), lambda t: F.struct(share(t).alias("share"), hit(t).alias("hits"), (t["family"] == F.col("family")).alias("own"), t["family"].alias("family")))
    found = found.withColumn("_all", compared)
    best = lambda rows: F.array_max(F.transform(rows, lambda t: F.struct(t["hits"], t["own"], -F.array_position(F.array(*map(F.lit, FAMILIES)), t["family"]), t["family"].alias("family"))))
    found = found.withColumn("_best", best(F.filter("_all", lambda t: t["share"] >= OVERTURNING)))
    family = F.coalesce("_best.family", "family")
    nearest = F.array_max(F.transform(F.filter("_all", lambda t: t["family"] == family), lambda t: F.struct(t["share"], t["hits"])))
    found = found.select("text_id", "run", "doc_id", "paragraph", "n_lines", family.alias("family"), "probability", nearest["share"].alias("similarity"), F.coalesce("_best.hits", nearest["hits"]).alias("hits"))
    run = W.partitionBy("text_id", "run")
    alone, together = (F.max(F.when(x, F.struct("similarity", "hits"))).over(run) for x in (F.col("n_lines") == 1, F.col("n_lines") > 1))
    better = F.coalesce(together > alone, together.isNotNull())
    rows = found.withColumn("better", better).where((F.col("n_lines") > 1) == F.col("better"))
    return rows.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= least_similarity).alias("confirmed"))
