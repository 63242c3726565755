"""The operators at work on the test tables, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.functions import labels as L
from facetloom.functions import numeric as N
from facetloom.functions import prompts as P
from facetloom.functions import text as X
from facetloom.operators import cards as cards_ops
from facetloom.operators import clustering, columns, density, emotions, features, legend, matching
from facetloom.operators import ordering, profiles, ranking, scoring, terms
from facetloom.plans import enrichment, personas
from facetloom.schemas import CLUSTERED
from facetloom.session import ensure_checkpoint_dir, pin
from facetloom.sources import blogs, index, tables
from facetloom.sources import cards as card_files

Query = Callable[[SparkSession, str], DataFrame]

GATE = 0.10
SURE = 0.08
NEAR = 0.25
SENTIMENTS = tuple(C.SENTIMENT_CLASSES)
SORTED_LABELS = sorted(C.EMOTION_LABELS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Over all cores, if the files hold fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", *names)
    return spread(docs, "doc_id")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the market segment of their customer as the cluster."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cluster")
    )
    return table(spark, sf, "orders").join(customer, "o_custkey")


def scored_documents(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    docs = documents(spark, sf, *names)
    scored = scoring.score_emotions(docs, "text", scoring.HashScorer())
    return scoring.score_sentiment(scored, "text", scoring.HashScorer(SENTIMENTS))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings")
    return embeddings.select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Rows, dates and lines.


def order_date_text() -> Column:
    """Order dates as blog dates; some are broken on purpose, by order key."""
    date = F.date_format("o_orderdate", "d,MMMM,yyyy")
    kind = F.col("o_orderkey") % 7
    return (
        F.when(kind == 0, F.concat(F.lit("on "), date))
        .when(kind == 1, F.upper(date))
        .when(kind == 2, F.concat(F.lit("00"), date))
        .when(kind == 3, F.concat(F.lit(" \t"), date, F.lit(" \n")))
        .when(kind == 4, F.lit("31,February,2004"))
        .otherwise(date)
    )


def generation_flags(spark: SparkSession, sf: str) -> DataFrame:
    age = F.when(F.col("o_custkey") % 5 == 0, F.lit("n/a")).otherwise(
        (F.col("o_custkey") % 60).cast("string")
    )
    rows = table(spark, sf, "orders").select(
        "o_orderkey", order_date_text().alias("date"), age.alias("age")
    )
    births = enrichment.add_cohort(rows)
    posts = enrichment.add_cohort(births.withColumnsRenamed(
        {"birth_year_est": "birth_year", "is_genz": "born_in_cohort"}
    ), date_is_birthdate=False)
    return posts.select(
        "o_orderkey", "birth_year", "born_in_cohort",
        F.col("birth_year_est").alias("post_birth_year"), F.col("is_genz").alias("post_in_cohort"),
    )


def blog_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as blog files: each sentence is dated by its first word."""
    body = F.regexp_replace("text", r"\. ([A-Za-z]+)", ".\r\n<date>$1</date>\r<post>\n $1")
    files = documents(spark, sf).select("doc_id", F.concat(F.lit("<Blog>\n"), body).alias("content"))
    return blogs.text_lines(files, "content")


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    asked = F.when(F.col("role") == "user", F.col("text"))
    carried = ordering.carry_forward(turns, ["conv_id"], "turn", asked, "last_user_text")
    return carried.select("conv_id", "turn", "role", "last_user_text")


def split_every_20th(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    files = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return ordering.split_by_index(files)


def row_range(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ordering.row_range(orders, 101, 1100, "o_orderkey")


def limit_then_filter(spark: SparkSession, sf: str) -> DataFrame:
    rated = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("is_genz"))
    return ordering.limit_then_filter(rated, 150, "doc_id")


def column_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Column selection on orders, and the fixed columns of the clustered table."""
    rows = segments(spark, sf)
    columns.require_columns(rows, ["cluster", "o_orderdate"])
    chosen = columns.select_categoricals(rows, max_cardinality=1000)
    numbers = columns.select_numerics(rows)
    wide = columns.ensure_columns(
        rows.select(F.col("o_orderstatus").alias("job"), F.lit(1).alias("cluster")),
        CLUSTERED,
    )
    return wide.groupBy("job", "top_emotion", "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.lit(",".join(chosen))).alias("categoricals"),
        F.first(F.lit(",".join(numbers))).alias("numerics"),
        F.lit(len(wide.columns)).alias("width"),
    )


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "lang", "n_chars")
    odd = F.col("doc_id") % 3 == 0
    padded = F.concat(F.lit("  \t"), F.col("lang"), F.lit("\n "))
    return docs.select(
        "doc_id",
        X.strip(padded).alias("stripped"),
        X.text_preview(F.col("text")).alias("preview"),
        F.length(X.embed_text(F.when(~odd, F.col("text")))).cast("bigint").alias("embedded"),
        F.length(X.embed_text(F.col("text"), C.EMBED_CHARS)).cast("bigint").alias("clipped"),
        X.scoring_text(F.when(~odd, F.col("lang")), "nan").alias("scored_as"),
        X.category_text(F.when(~odd, F.col("lang"))).alias("category"),
        X.to_number(F.when(odd, F.lit("x")).otherwise(F.col("n_chars").cast("string"))).alias("number"),
        N.clamp01(F.col("n_chars") / 1000.0 - 0.5).alias("clamped"),
        N.round_half_even(F.col("n_chars") / 8.0, 2).alias("rounded"),
        L.sentiment_score(F.when(odd, F.lit(" Positive ")).when(F.col("lang") == "fr", "NEGATIVE")).alias("sentiment"),
        L.tone(F.when(odd, F.col("n_chars") / 1000.0 - 1.0)).alias("tone"),
        L.map_sentiment_label(
            F.when(odd, F.lit("LABEL_0")).when(F.col("lang") == "fr", "LABEL_2").when(F.col("lang") == "de", "other")
        ).alias("mapped"),
    )


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings stretched by their id and scaled back; one in ten is zero."""
    factor = F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(F.col("vec_id") + 1.0)
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.transform("embedding", lambda x: (x * factor).cast("float")).alias("v")
    )
    unit = rows.select("vec_id", "embedding", N.l2_normalize(F.col("v")).alias("u"))
    return unit.select(
        "vec_id",
        F.round(N.dot(F.col("u"), F.col("u")), 5).alias("norm2"),
        F.round(N.dot(F.col("u"), F.col("embedding")), 5).alias("cosine"),
    )


# Scores.


def emotion_top5(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    scored = scoring.score_emotions(docs, "text", scoring.HashScorer())
    slots = [f"emo{i}_{part}" for i in range(1, 6) for part in ("label", "conf")]
    confs = [f"emo{i}_conf" for i in range(1, 6)]
    return rounded(scored.select("doc_id", "top_emotion", "emotion_sentiment", *slots), *confs)


def top_emotion(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return scoring.add_top_emotion(docs, "text", scoring.HashScorer()).select("doc_id", "top_emotion")


def emotion_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "lang")
    scored = scoring.score_emotions(docs, "text", scoring.HashScorer())
    counts = scored.groupBy("lang", "emotion_sentiment").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select(
        "lang", "emotion_sentiment", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")
    )


def lexicon_emotions(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    lexicon = scoring.corpus_lexicon(docs, "text")
    scorer = scoring.LexiconScorer(lexicon, "doc_id")
    scored = scoring.score_emotions(docs.select("doc_id", "text"), "text", scorer)
    return rounded(scored.select("doc_id", "top_emotion", "emotion_conf", "emo2_label"), "emotion_conf")


def sentiment_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    scored = scoring.score_sentiment(docs, "text", scoring.HashScorer(SENTIMENTS))
    return rounded(scored.select("doc_id", "reddit_sentiment", "reddit_conf"), "reddit_conf")


def confidence_gate_masking(spark: SparkSession, sf: str) -> DataFrame:
    gated = columns.add_masking(columns.confidence_gate(scored_documents(spark, sf), GATE))
    return gated.select("doc_id", "emotion_sentiment", "reddit_sentiment", "masking")


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(columns.quality_report(scored_documents(spark, sf), GATE), "masking_rate")


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A model that fails on some texts: only those rows are left without scores."""

    def make_model():
        def model(texts):
            out = []
            for text in texts:
                if text.count("a") % 7 == 3:
                    raise ValueError("text refused")
                letters = len(text) + 1
                out.append(
                    [
                        {"label": "joy", "score": text.count("e") / letters},
                        {"label": "fear", "score": text.count("n") / letters},
                    ]
                )
            return out

        return model

    scored = scoring.score_emotions(documents(spark, sf), "text", scoring.ModelScorer(make_model))
    return rounded(scored.select("doc_id", "top_emotion", "emotion_conf"), "emotion_conf")


def model_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Letter counts as an encoder; it refuses texts with many z."""

    def make_model():
        def model(texts):
            vectors = [[t.count("e"), t.count("n"), t.count("z")] for t in texts]
            if any(v[2] > 3 for v in vectors):
                raise ValueError("too many z")
            return vectors

        return model

    made = scoring.embed(documents(spark, sf), "text", make_model)
    parts = [F.col("vector")[i].cast("double").alias(f"e{i}") for i in range(3)]
    return rounded(made.select("doc_id", *parts), "e0", "e1", "e2", digits=4)


# Profiles.

ORDER_FEATURES = ("o_orderpriority", "o_orderstatus")


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.cluster_sizes(segments(spark, sf))


def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.crosstab(segments(spark, sf), ORDER_FEATURES)


def chi_square_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Segments against order features, and returned or not against the line status."""
    orders = profiles.chi_square(segments(spark, sf), ORDER_FEATURES)
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("cluster"), "l_linestatus"
    )
    tests = orders.unionByName(profiles.chi_square(lines, ["l_linestatus"]))
    return rounded(tests.drop("p_value"), "chi2", "cramers_v", "effect")


def strongest_associations(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "cluster")
    tests = profiles.chi_square(
        lines.withColumn("quantity", F.col("l_quantity").cast("string")),
        ["l_linestatus", "quantity", "cluster"],
    )
    return rounded(profiles.strongest_associations(tests).select("feature", "dof", "effect"), "effect")


def value_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.order_profiles(profiles.value_profiles(segments(spark, sf), ORDER_FEATURES, zeros=True))


def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    summary = profiles.numeric_summary(lines, names, "l_returnflag")
    return rounded(summary, *[c for c in summary.columns if c != "cluster"], digits=4)


# Emotions, terms and cards; the language stands for the persona.


def emotion_wide(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    scored = scoring.score_emotions(docs, "text", scoring.HashScorer())
    wide = emotions.emotion_wide(scored, SORTED_LABELS)
    names = [f"emotion_{label}" for label in SORTED_LABELS]
    return rounded(wide.select("doc_id", *names), *names)


def persona_emotions(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "lang")
    scored = scoring.score_emotions(docs, "text", scoring.HashScorer())
    top = emotions.persona_emotions(scored, "lang", labels=SORTED_LABELS)
    return rounded(top, "avg_conf")


def persona_base(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "lang")
    scored = scoring.score_sentiment(docs, "text", scoring.HashScorer(SENTIMENTS))
    base = cards_ops.persona_base(scored, "lang")
    return rounded(base, "share", "avg_sentiment_score")


def most_common(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", F.when(F.col("doc_id") % 9 != 4, F.col("source")).alias("source")
    )
    return cards_ops.most_common(docs, "source", "lang", row_id="doc_id")


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_stats(documents(spark, sf), "text")


def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return rounded(terms.fit_tfidf(docs, "text", min_df=2).long(docs, "doc_id"), "weight")


def persona_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "lang")
    return rounded(terms.top_terms(docs, terms.fit_tfidf(docs, "text"), "lang"), "weight")


def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.binned(segments(spark, sf), ["o_totalprice"])
    scores = ranking.mutual_information(rows, ["o_orderpriority", "o_orderstatus", "o_totalprice"], "cluster")
    return rounded(scores, "score", digits=8)


def vector_information(spark: SparkSession, sf: str) -> DataFrame:
    """The positions of the embeddings that tell most of their label."""
    names = [f"dim_{i}" for i in range(64)]
    scores = ranking.vector_information(vectors(spark, sf), names, "label")
    return rounded(scores, "score", digits=8)


def legend_colors(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding labels as clusters; label 3 stands for noise."""
    rows = table(spark, sf, "embeddings").select(
        F.when(F.col("label") == 3, -1).otherwise(F.col("label")).alias("cluster")
    )
    return legend.cluster_legend(rows)


def cluster_colors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return legend.add_cluster_colors(rows, legend.cluster_legend(rows))


# Matching; the label stands for the persona, and each row asks for the next label.


def asked_and_held(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    asked = rows.select(
        F.col("vec_id").alias("query_id"),
        ((F.col("label") + 1) % 10).alias("persona_id"),
        F.col("embedding").alias("vector"),
    )
    held = rows.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").alias("persona_id"),
        F.col("embedding").alias("vector"),
    )
    return asked, held


def nearest_in_persona(spark: SparkSession, sf: str) -> DataFrame:
    near = matching.similarity_gate(matching.match(*asked_and_held(spark, sf)), NEAR)
    return rounded(near, "similarity")


def nearest_three(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matching.match(*asked_and_held(spark, sf), k=3), "similarity")


def nearest_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The way for more queries than a broadcast may hold."""
    found = matching.match(*asked_and_held(spark, sf), pass_queries=256)
    return rounded(found, "similarity")


def match_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Text ids, a persona without rows, and index rows whose vector holds no number."""
    asked, held = asked_and_held(spark, sf)
    persona = F.concat(F.lit("p"), F.col("persona_id").cast("string"))
    rows = held.select(
        F.concat(F.lit("r"), F.lpad(F.col("row_id").cast("string"), 9, "0")).alias("row_id"),
        persona.alias("persona_id"),
        F.when(
            F.col("row_id") % 50 == 7, F.transform("vector", lambda x: x * F.lit(float("nan")))
        ).otherwise(F.col("vector").cast("array<double>")).alias("vector"),
    )
    queries = held.select(
        F.concat(F.lit("q"), F.col("row_id").cast("string")).alias("query_id"),
        F.when(F.col("persona_id") == 9, "none").otherwise(persona).alias("persona_id"),
        "vector",
    )
    found = matching.match(queries, rows, keep_unmatched=True)
    return rounded(found.select("query_id", "persona_id", "row_id", "similarity"), "similarity")


def silhouette_score(spark: SparkSession, sf: str) -> DataFrame:
    """How well the labels of the embeddings separate them."""
    labelled = vectors(spark, sf).withColumn("cluster", F.col("label"))
    score = clustering.silhouette(labelled)
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


def sure_slots(df: DataFrame) -> DataFrame:
    return rounded(df, *[f"emo{i}_conf" for i in range(1, 6)], digits=4)


def high_conf_attributes(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "lang")
    scored = sure_slots(scoring.score_emotions(docs, "text", scoring.HashScorer()))
    found = scored.withColumn("sure", P.emotions_json(L.high_conf_emotions(SURE)))
    kept = columns.drop_text_and_low_conf(found, SURE)
    slots = [f"emo{i}_{part}" for i in range(1, 6) for part in ("label", "conf")]
    return kept.select("doc_id", "lang", "sure", *slots)


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows with the attributes of the document of the same number."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "text", "lang", F.col("source").alias("job")
    )
    rows = spread(asked_and_held(spark, sf)[1].join(docs, "row_id"), "row_id")
    scored = sure_slots(scoring.score_emotions(rows, "text", scoring.HashScorer()))
    slots = [f"emo{i}_{part}" for i in range(1, 6) for part in ("label", "conf")]
    path = scratch(spark, "rows")
    index.write_persona_index(
        scored.select("row_id", "persona_id", "vector", "text", "lang", "job", *slots), path
    )
    return index.read_persona_index(spark, path).select(
        "row_id", "persona_id", "vector", "text", "lang", "job", *slots
    )


def prompt_records(spark: SparkSession, sf: str) -> DataFrame:
    """Match records; the cards lack persona 0."""
    held = index_rows(spark, sf)
    texts = held.select(F.col("row_id").alias("query_id"), "text")
    asked = asked_and_held(spark, sf)[0].join(texts, "query_id")
    members = held.where(F.col("persona_id") > 0)
    words = terms.fit_tfidf(members, "text")
    made = cards_ops.persona_cards(members, words, row_id="row_id")
    records = matching.match_records(asked, held, made, threshold=NEAR, min_confidence=SURE)
    return rounded(
        records.select(
            "query_id",
            "persona_id",
            "similarity",
            "matched_row_id",
            "used_attributes",
            "attributes_sent",
            F.col("prompt_preview")[0]["content"].alias("system_content"),
            F.col("prompt_preview")[1]["content"].alias("user_content"),
            "reaction",
            "error",
        ),
        "similarity",
    )


# Files.


def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as CSV, kept as parquet, read back."""
    path = scratch(spark, "csv")
    docs = documents(spark, sf, "lang").withColumn("date", F.lit("5,May,2004"))
    hard = docs.select(
        (F.col("doc_id") + 9007199254740993).alias("doc_id"),
        F.lit('  lead, "quoted" and trail  \t\n next line ').alias("text"),
        F.lit("").alias("lang"),
        F.lit(None).cast("string").alias("date"),
    )
    docs = docs.unionByName(hard)
    tables.write_csv(docs, path, ["doc_id"])
    return tables.materialize_parquet(
        spark, path, scratch(spark, "parquet"), "doc_id bigint, text string, lang string, date string"
    )


def published_dataset(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "dataset")
    files = split_every_20th(spark, sf)
    tables.write_dataset(files, path)
    return tables.read_dataset(spark, path, "validation").select("path", "file_idx", "split")


def persona_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "index")
    held = asked_and_held(spark, sf)[1]
    index.write_persona_index(index.build_index(held), path)
    one = index.read_persona_index(spark, path, C.DEFAULT_PERSONA)
    return one.select("row_id", "persona_id", F.size("vector").alias("width"))


def cards_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "cards")
    docs = pin(scored_documents(spark, sf, "lang", "source").withColumnRenamed("source", "job"))
    made = cards_ops.persona_cards(docs, terms.fit_tfidf(docs, "text"), "lang", "doc_id")
    card_files.write_cards(cards_ops.run_summary(made, "documents", 0.5, group="lang"), path)
    back = card_files.read_cards(spark, path)
    return rounded(
        back.select(
            "persona_id",
            "size",
            "share",
            "avg_sentiment_score",
            F.array_join("top_words", "|").alias("top_words"),
            F.array_join(F.transform("top_emotions", lambda e: e["emotion"]), "|").alias("top_emotions"),
            F.array_join("job_top", "|").alias("job_top"),
        ),
        "share",
        "avg_sentiment_score",
    )


# Feature blocks.


def numeric_block(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with their prices; every seventh discount is missing."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("discount"),
        F.lit(1).alias("flag"),
    )
    names = ["l_quantity", "l_extendedprice", "discount", "flag"]
    block = features.numeric_block(lines, names).withColumn("v", vector_to_array("numeric_block"))
    parts = [F.round(F.col("v")[i], 6).alias(f"n{i}") for i in range(4)]
    return block.select("l_orderkey", "l_linenumber", *parts)


def categorical_block(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"),
    )
    block = features.categorical_block(orders, ["o_orderpriority", "status"])
    block = block.withColumn("v", vector_to_array("categorical_block"))
    parts = [F.round(F.col("v")[i], 6).alias(f"c{i}") for i in range(9)]
    return block.select("o_orderkey", *parts)


# Models, without a SQL form.


def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    encoder = scoring.fit_text_encoder(docs, "text", 256)
    return scoring.embed(docs, "text", encoder).select("doc_id", "vector")


def feature_blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = pin(scored_documents(spark, sf, "lang", "source").withColumnRenamed("source", "job"))
    encoder = scoring.fit_text_encoder(docs, "text", 256)
    blocks = features.feature_blocks(scoring.embed(docs, "text", encoder), "vector")
    return blocks.select("doc_id", vector_to_array("features").alias("features"))


def pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    reduced = features.reduce_pca(vectors(spark, sf))
    return features.project_2d(reduced).select("vec_id", "x2d", "y2d")


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    reduced = features.reduce_pca(vectors(spark, sf))
    return clustering.kmeans(reduced).select("vec_id", "cluster")


def svd_features(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    weighted = terms.fit_tfidf(docs, "text").transform(docs).select("doc_id", "tfidf")
    return features.svd(weighted).select("doc_id", vector_to_array("svd").alias("svd"))


def persona_features(spark: SparkSession, sf: str) -> DataFrame:
    docs = pin(scored_documents(spark, sf, "lang", "source").withColumnRenamed("source", "job"))
    ready, _ = features.persona_features(docs)
    return ready.select("doc_id", vector_to_array("features").alias("features"))


def persona_map(spark: SparkSession, sf: str) -> DataFrame:
    """The clustered table of the documents: vectors, blocks, clusters, places, colours."""
    docs = pin(scored_documents(spark, sf, "lang", "source").withColumnRenamed("source", "job"))
    encoder = scoring.fit_text_encoder(docs, "text", 256)
    placed, _ = personas.map_clusters(docs, encoder, keep=["doc_id"])
    return placed.select("doc_id", "top_emotion", "job", "cluster", "x2d", "y2d", "cluster_color_name")


def choose_k(spark: SparkSession, sf: str) -> DataFrame:
    chosen = clustering.choose_k(vectors(spark, sf))
    return clustering.assign_personas(vectors(spark, sf), chosen).select("vec_id", "persona_id")


def corner_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers near one corner for each region, off it by their balance."""
    off = F.col("c_acctbal") / 10_000.0
    corner = [(F.col("n_regionkey") == r).cast("double") * 100 for r in range(5)]
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, sf, "customer").join(F.broadcast(nations), "c_nationkey").select(
        "c_custkey", array_to_vector(F.array(*corner, off)).alias("features")
    )


def choose_k_separable(spark: SparkSession, sf: str) -> DataFrame:
    """Number of clusters and members where they are plain; a cluster is named by its first member."""
    rows = corner_customers(spark, sf)
    chosen = clustering.choose_k(rows)
    found = clustering.assign_personas(rows, chosen)
    named = found.groupBy("persona_id").agg(F.min("c_custkey").alias("first_member"))
    return found.join(F.broadcast(named), "persona_id").select(
        "c_custkey", "first_member", F.lit(chosen.k).alias("k"), F.lit(round(chosen.score, 4)).alias("score")
    )


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"dim_{i}" for i in range(64)]
    rows = spread(vectors(spark, sf), "vec_id")
    return ranking.permutation_importance(rows, names, "label", "vec_id")


def products(df: DataFrame, column: str) -> DataFrame:
    """Squared length of each row, and its inner product with the row of the next id."""
    rows = pin(df.select("vec_id", vector_to_array(column).alias("x")))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda v, w: v * w), F.lit(0.0), lambda total, v: total + v)

    return rows.join(after, "vec_id", "left").select(
        "vec_id", F.round(dot("x", "x"), 6).alias("norm"), F.round(dot("x", "y"), 6).alias("next_product")
    )


def pca_products(spark: SparkSession, sf: str) -> DataFrame:
    """With all directions that vary, components keep the inner products of the centred rows."""
    flat = F.concat(F.array(F.lit(3.0)), vector_to_array("features"))
    rows = vectors(spark, sf).withColumn("features", array_to_vector(flat))
    return products(features.reduce_pca(rows, 64), "reduced")


def svd_products(spark: SparkSession, sf: str) -> DataFrame:
    """With all singular vectors, coordinates keep the inner products of the rows."""
    return products(features.svd(vectors(spark, sf), 64, "features"), "svd")


def kmeans_separable(spark: SparkSession, sf: str) -> DataFrame:
    """K-means where the clusters are plain; a cluster is named by its first member."""
    found = clustering.kmeans(corner_customers(spark, sf), 5, "features")
    named = found.groupBy("cluster").agg(F.min("c_custkey").alias("first_member"))
    return found.join(F.broadcast(named), "cluster").select("c_custkey", "first_member")


def feature_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Text, numeric and categorical block of the embeddings, weighted; first and last places of each."""
    kind = F.when(F.col("label") % 3 == 0, "a").when(F.col("label") % 3 == 1, "b")
    rows = table(spark, sf, "embeddings").withColumn("kind", kind)
    blocks = features.feature_blocks(rows, "embedding", ["vec_id", "label"], ["kind", "gone"], (1.0, 2.0, 0.5))
    places = [0, 63, 64, 65, 66, 67, 68, 69]
    out = blocks.select("vec_id", vector_to_array("features").alias("x"))
    return out.select("vec_id", F.size("x").alias("width"), *[F.round(F.col("x")[i], 6).alias(f"f{i}") for i in places])


def importance_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by region: one feature tells it, one is constant, one has nothing to do with it."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = table(spark, sf, "customer").join(F.broadcast(nations), "c_nationkey").select(
        "c_custkey", F.col("n_regionkey").alias("persona_id"),
        array_to_vector(F.array(F.lit(7.0), F.col("n_regionkey").cast("double"), "c_acctbal")).alias("features"),
    )
    found = ranking.permutation_importance(
        spread(rows, "c_custkey"), ["constant", "region", "balance"], row_id="c_custkey"
    )
    return rounded(found, "score", digits=1)


def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by balance and nation; a cluster is a crowd without a gap."""
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 250.0).alias("x"),
        (F.col("c_nationkey") * 2.0).alias("y"),
    )
    found = clustering.density_clusters(rows, ["x", "y"], 1.0, 5, 30, spread_by=["c_custkey"])
    return found.select("c_custkey", "cluster")


def density_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings in all their dimensions: a cluster is a chain of crowded vectors."""
    found = density.distance_clusters(
        vectors(spark, sf), 1.15, min_points=4, min_size=3, features="features", row_id="vec_id"
    )
    return found.select("vec_id", "cluster")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        emotion_sentiment, generation_flags, blog_lines, carry_forward, split_every_20th,
        row_range, limit_then_filter, column_checks, scalar_functions, unit_vectors,
        emotion_top5, top_emotion, lexicon_emotions, sentiment_scores, confidence_gate_masking,
        quality_report, model_scores, model_embeddings, numeric_block, categorical_block, cluster_sizes, crosstab, chi_square_tests,
        strongest_associations, value_profiles, numeric_summary, emotion_wide, persona_emotions,
        persona_base, most_common, term_stats, tfidf_terms, persona_top_terms,
        mutual_information, vector_information, legend_colors, cluster_colors, nearest_in_persona, nearest_three,
        nearest_in_blocks, match_edges, silhouette_score, high_conf_attributes, prompt_records, csv_table, published_dataset,
        persona_index, cards_json, hashed_embeddings, feature_blocks, pca_2d, kmeans_clusters,
        svd_features, persona_features, persona_map, choose_k, choose_k_separable, permutation_importance, importance_planted,
        pca_products, svd_products, kmeans_separable, feature_parts, density_clusters, density_vectors,
    )
}
