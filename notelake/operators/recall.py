"""Ranked lexical retrieval for one or many questions, over an index that is written once.

The index holds token sets, the postings of title words and the classes of documents with equal tags and stack, with document frequencies. A
score depends on the title words that a question hits, on the number of title words, and on the class; equal scores go by path. So

* words of few titles (``RARE``) are joined with their postings;
* of the words of many titles that the questions ask for, a document has a set; documents of one set, title size and class have one score
  for any question, so the first of them by path are enough, and a question meets sets instead of documents, in as many tasks as there are meetings for;
  of these only its best go on;
* tags and stack are met by class, of which the first by path are enough;
* documents that share no term enter by path, as far as the leaders are not filled.

What is scored is thus bounded for each question by its words, by ``RARE``, and by the sets and classes there are, not by the documents that hold
a frequent word. Bodies are read for the leaders alone, and do not move where these are few. Sums run over sorted arrays in one
row, so they are the same on every partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.score import NEIGHBOUR, blend, decide, f2, idf, round3, saturated
from notelake.functions.text import STOPWORDS, terms, token_set, tokens
from notelake.session import materialize

LEADERS, SHOWN = 20, 10
#: Leaders of all questions up to which the bodies stay where they are.
MOST_BROADCAST = 50_000
#: Titles that a word may be in to be met through its postings; frequent words of all questions that make up sets.
RARE, SETS = 300, 4096
#: Meetings of a question and a title in a frequent word that a task counts.
MET = 1 << 18
NOTHING = "cast(array() as array<string>)"


def _weights(questions: DataFrame, wanted: str, frequency: DataFrame, n: int) -> DataFrame:
    """question_id, term, weight: an absent term weighs the mean of the present ones."""
    rows = questions.select("question_id", F.posexplode(wanted).alias("pos", "term")).join(frequency, "term", "left")
    rows = rows.withColumn("idf", idf(F.coalesce("df", F.lit(0)), F.lit(n)))
    per = Window.partitionBy("question_id")
    present = F.array_sort(F.collect_list(F.when(F.col("df") > 0, F.struct("pos", "idf"))).over(per))
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x["idf"]) / F.size(present)).otherwise(F.lit(0.0))
    return rows.select("question_id", "pos", "term", F.when(F.col("df") > 0, F.col("idf")).otherwise(mean).alias("weight"))


@dataclass
class Index:
    """fronts: rel, cls, titled, title_set; classes: cls, tag_set, stack_set; heads: cls, rel; postings: term, rel; stats: term, title_df, tag_df, stack_df; n documents."""

    documents: DataFrame
    fronts: DataFrame
    classes: DataFrame
    heads: DataFrame
    postings: DataFrame
    stats: DataFrame
    first: DataFrame
    n: int


def index(documents: DataFrame, most: int = LEADERS + SHOWN) -> Index:
    """documents: rel, slug, title, tags, stack, body. ``most``: how many candidates a question may need."""
    words = F.concat(tokens(F.coalesce("title", F.lit(""))), tokens(F.replace(F.coalesce("slug", F.lit("")), F.lit("-"), F.lit(" "))))
    sets = documents.select("rel", F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS)))).alias("title_set"), token_set(F.col("tags")).alias("tag_set"), token_set(F.col("stack")).alias("stack_set"))
    sets = materialize(sets.withColumns({"cls": F.xxhash64("tag_set", "stack_set"), "titled": F.size("title_set") > 0}), "recall")
    classes = materialize(sets.groupBy("cls", "tag_set", "stack_set").agg(F.count("*").alias("n")), "recall-classes")
    place = F.row_number().over(Window.partitionBy("titled", "cls").orderBy("rel"))
    heads = materialize(sets.select("rel", "cls", "titled", place.alias("place")).where(F.col("place") <= most).select("cls", "rel"), "recall-heads")
    postings = materialize(sets.select(F.explode("title_set").alias("term"), "rel").repartitionByRange("term").sortWithinPartitions("term"), "recall-postings")
    counts = lambda rows, c: rows.groupBy("term").agg(F.sum("n").alias(c))
    title = counts(postings.withColumn("n", F.lit(1)), "title_df")
    tag, stack = (counts(classes.select(F.explode(c).alias("term"), "n"), f) for c, f in (("tag_set", "tag_df"), ("stack_set", "stack_df")))
    stats = materialize(title.join(tag, "term", "full_outer").join(stack, "term", "full_outer").na.fill(0), "recall-stats")
    first = materialize(sets.select("rel").orderBy("rel").limit(most + LEADERS), "recall-first")
    n = classes.agg(F.sum("n")).first()[0] or 0
    return Index(documents, sets.select("rel", "cls", "title_set"), classes.drop("n"), heads, postings, stats, first, n)


def _weighted(w: Column, have: Column) -> tuple[Column, Column]:
    """Whether a channel counts, and the share of the weights that it has."""
    den = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["weight"])
    num = F.aggregate(F.filter(w, lambda x: F.array_contains(have, x["term"])), F.lit(0.0), lambda a, x: a + x["weight"])
    active = (F.coalesce(den, F.lit(0.0)) > 0) & (F.size(have) > 0)
    return active, F.when(active, num / den).otherwise(F.lit(0.0))


def _frequent(ix: Index, scope: DataFrame, shared: DataFrame, frequent: dict[str, int], most: int) -> DataFrame:
    """question_id, rel: of each question the ``most`` best by the words of ``frequent``, tags and stack alone, if they hold such a word.

    ``frequent``: words, and how often questions and titles meet in them. A document with no other word of the question has its true score here, and
    one with others no more than it; the latter comes by postings too. So of the former none is lost that is among the ``most`` best of all.
    """
    held = F.filter("title_set", lambda t: t.isin(list(frequent)))  # a hash set; titles are short
    rows = ix.fronts.select("rel", "cls", F.size("title_set").alias("size"), held.alias("held")).where(F.size("held") > 0)
    place = F.row_number().over(Window.partitionBy("held", "size", "cls").orderBy("rel"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= most).drop("place")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(frequent.values()) // MET)
    den = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x["weight"])
    weighs = lambda w: F.coalesce(den(F.col(w)), F.lit(0.0)) > 0
    asking = scope.select("question_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"), weighs("tag_w").alias("tag_any"), weighs("stack_w").alias("stack_any"))
    told = firsts.repartition(tasks, "rel").select("rel", "cls", "size", F.explode("held").alias("term")).join(asking, "term")
    met = told.groupBy("question_id", "rel").agg(F.count("*").alias("hits"), *(F.first(c).alias(c) for c in ("cls", "size", "n_terms", "tag_any", "stack_any")))
    sides = ix.classes.select("cls", (F.size("tag_set") > 0).alias("tag_has"), (F.size("stack_set") > 0).alias("stack_has"))
    met = met.join(sides, "cls").join(shared, ["question_id", "cls"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    channels = [("title", F.col("size") > 0, f2(F.col("hits"), F.col("n_terms"), F.col("size"))), *((f"{c}s" if c == "tag" else c, F.col(f"{c}_any") & F.col(f"{c}_has"), zero(F.col(f"{c}_v"))) for c in ("tag", "stack"))]
    scored = met.select("question_id", "rel", blend(channels).alias("score"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "rel"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("question_id", "rel")


def ranked(documents: DataFrame, questions: DataFrame, leaders: int = LEADERS, shown: int = SHOWN) -> DataFrame:
    """question_id, rank, rel, score, matched_on of the candidates shown; see :func:`ask`."""
    return ask(index(documents, leaders + shown), questions, leaders, shown)


def ask(ix: Index, questions: DataFrame, leaders: int = LEADERS, shown: int = SHOWN) -> DataFrame:
    """question_id, rank, rel, score, matched_on of the candidates shown.

    questions: question_id, question, stack. ``leaders`` and ``shown`` together are at most what the index was made for.
    """
    n, most = ix.n, leaders + shown
    asked = questions.select("question_id", terms(F.coalesce("question", F.lit(""))).alias("terms"), terms(F.concat_ws(" ", F.coalesce("stack", F.expr(NOTHING)))).alias("hints"))
    words = asked.select(F.explode(F.array_union("terms", "hints")).alias("term")).distinct()
    known_words = materialize(ix.stats.join(words, "term", "left_semi"), "asked")
    tag_df, stack_df = (known_words.where(F.col(c) > 0).select("term", F.col(c).alias("df")) for c in ("tag_df", "stack_df"))
    # hints count where some document carries them; question terms always
    known = asked.select("question_id", F.posexplode("hints").alias("pos", "term")).join(stack_df.select("term"), "term", "left_semi")
    known = known.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("known"))
    scope = asked.join(known, "question_id", "left").withColumn("stack_terms", F.array_distinct(F.concat(F.coalesce("known", F.expr(NOTHING)), "terms")))
    gather = lambda w, name: w.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "weight"))).alias(name))
    tag_w, stack_w = _weights(scope, "terms", tag_df, n), _weights(scope, "stack_terms", stack_df, n)
    scope = materialize(scope.join(gather(tag_w, "tag_w"), "question_id", "left").join(gather(stack_w, "stack_w"), "question_id", "left"), "questions")

    asking = scope.select("question_id", F.explode("terms").alias("term"))
    titled = known_words.where("title_df > 0").select("term", "title_df")
    rare = asking.join(titled.where(F.col("title_df") <= RARE), "term").join(ix.postings, "term").select("question_id", "rel")
    # of equal scores the first by path: of a class no more than ``most`` without a title word can be among the candidates
    either = ix.classes.select("cls", F.explode(F.array_union("tag_set", "stack_set")).alias("term"))
    wanted = scope.select("question_id", F.explode(F.array_union("terms", "stack_terms")).alias("term"))
    sharing = wanted.join(either, "term").select("question_id", "cls").distinct().join(ix.classes, "cls").join(scope, "question_id")
    shared = materialize(sharing.select("question_id", "cls", *(_weighted(F.col(f"{c}_w"), F.col(f"{c}_set"))[1].alias(f"{c}_v") for c in ("tag", "stack"))), "recall-shared")
    by_class = shared.select("question_id", "cls").join(ix.heads, "cls").select("question_id", "rel")
    by_path = scope.select("question_id").crossJoin(F.broadcast(ix.first.orderBy("rel").limit(2 * leaders)))  # 2 * leaders rows on the right
    pairs = rare.union(by_class).union(by_path)
    askers = asking.groupBy("term").agg(F.count("*").alias("askers"))
    frequent = {r["term"]: r["title_df"] * r["askers"] for r in titled.where(F.col("title_df") > RARE).join(askers, "term").orderBy(F.desc("title_df"), "term").limit(SETS + 1).collect()}
    if len(frequent) > SETS:  # the least frequent of them are met through their postings
        frequent = dict(list(frequent.items())[:SETS])
        beyond = titled.where(F.col("title_df") > RARE).where(~F.col("term").isin(list(frequent)))
        pairs = pairs.union(asking.join(beyond, "term").join(ix.postings, "term").select("question_id", "rel"))
    if frequent:
        pairs = pairs.union(_frequent(ix, scope, shared, frequent, most))
    scored = pairs.distinct().join(ix.fronts, "rel").join(ix.classes, "cls").join(scope, "question_id")

    title = f2(F.size(F.array_intersect("terms", "title_set")), F.size("terms"), F.size("title_set"))
    tag_on, tag_v = _weighted(F.col("tag_w"), F.col("tag_set"))
    stack_on, stack_v = _weighted(F.col("stack_w"), F.col("stack_set"))
    first = scored.select(
        "question_id", "rel", (F.size("title_set") > 0).alias("title_on"), title.alias("title_v"), tag_on.alias("tags_on"), tag_v.alias("tags_v"), stack_on.alias("stack_on"), stack_v.alias("stack_v")
    )
    front_channels = [(c, F.col(f"{c}_on"), F.col(f"{c}_v")) for c in ("title", "tags", "stack")]
    order = lambda: Window.partitionBy("question_id").orderBy(F.col("score").desc(), "rel")
    first = first.withColumn("score", blend(front_channels)).withColumn("rank", F.row_number().over(order()))
    # beyond the leaders a document keeps its score without a body, if that is above zero
    first = materialize(first.where(F.col("rank") <= leaders + shown), "leaders").join(scope.select("question_id", "terms"), "question_id")
    lead, rest = first.where(F.col("rank") <= leaders), first.where((F.col("rank") > leaders) & (F.col("rank") <= leaders + shown) & (F.col("score") > 0))
    few = F.broadcast(lead) if lead.count() <= MOST_BROADCAST else lead  # leaders a question, some hundred bytes each
    read = ix.documents.select("rel", "body").join(few, "rel").withColumn("body_v", saturated(tokens(F.coalesce("body", F.lit(""))), F.col("terms")))
    full = [*front_channels, ("body", F.lit(True), F.col("body_v"))]
    named = lambda channels: F.filter(F.array(*(F.when(on & (v > 0), F.lit(c)) for c, on, v in channels)), lambda c: c.isNotNull())
    both = read.select("question_id", "rel", blend(full).alias("score"), named(full).alias("matched_on")).unionByName(rest.select("question_id", "rel", "score", named(front_channels).alias("matched_on")))
    final = both.where("score > 0").withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= shown)
    return final.select("question_id", "rank", "rel", round3(F.col("score")).alias("score"), F.array_join("matched_on", ",").alias("matched_on"))


def verdicts(candidates: DataFrame, questions: DataFrame, stale: DataFrame) -> DataFrame:
    """question_id, verdict, top_score, neighbours. stale: rel, stale."""
    marked = candidates.join(stale, "rel", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    top = marked.groupBy("question_id").agg(
        F.min_by(F.struct("score", "stale"), "rank").alias("top"), F.sum(F.when((F.col("score") >= NEIGHBOUR) & (F.col("score") < 0.55), 1).otherwise(0)).alias("near")
    )
    rows = questions.select("question_id").join(top, "question_id", "left").withColumn("verdict", decide(F.col("top.score"), F.col("top.stale")))
    return rows.select("question_id", "verdict", F.coalesce("top.score", F.lit(0.0)).alias("top_score"), F.when(F.col("verdict") == "CREATE", F.coalesce("near", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("neighbours"))

