"""Registered queries: every operator over the provided tables.

`documents.lang` stands in for the subject, `conversations` turns for slides, `pages.html`
for slide markup, and the folder in `pages.url` for a subject folder.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicweir.config import TrainSettings
from topicweir.functions import scores, text as tx
from topicweir.functions.fixed_values import STOPWORDS_ENGLISH
from topicweir.operators import classify, dataset, evaluate, extraction, features, keywords, report, similarity, training
from topicweir.plans.batch_job import classify_decks
from topicweir.plans.deck_rows import document_decks
from topicweir.plans.train_job import train
from topicweir.runtime import fresh_path, per_class_window, spread, write_once
from topicweir.sources import decks, dictionary as dictionaries, sinks
from topicweir.sources.dictionary import KeywordDictionary

SUBJECTS = ["en", "fr", "de", "es"]
SUBJECTS_AND_ABSENT = [*SUBJECTS, "zh"]
WORDS = KeywordDictionary.of(
    {
        "en": ["the", "that", "with", "from", "this", "which", "ing ", "tion "],
        "fr": ["les", "que", "pour", "dans", "une", "avec", "eaux", "ment "],
        "de": ["und", "der", "die", "nicht", "mit", "ein", "für", "sch"],
        "es": ["los", "que", "para", "con", "una", "por", "ción", "ado "],
    }
)
# Upper case on purpose: entries are lowered or not, depending on the operator.
MIXED_CASE = KeywordDictionary.of({s: [*ws, ws[0].upper(), ws[1]] for s, ws in WORDS.entries})
DESCRIPTIONS = {"en": "english prose", "fr": "prose française", "de": "deutsche prosa"}
ACCENTS = r"\x{e0}-\x{ff}"
LETTERS = "a-z" + ACCENTS
# Terms with frequencies that overlap and contain one another.
PARTICLES = {
    "the": 900, "th": 300, "her": 200, "er": 700, "ere": 40, "tion": 120, "ion": 60, "ing": 250, "in": 500,
    "ment": 90, "men": 70, "ent": 110, "en": 800, "sch": 150, "ein": 220, "keit": 30, "eaux": 10, "que": 260,
    "ción": 25, "ado": 45, "ad": 90, "do": 95, "ont": 33, "on": 410, "nt": 35, "ères": 5, "re": 300,
}
CUSTOM_STOP = ["les", "que", "und", "der", "los"]
FLOOR = 0.85  # of agreement with the teacher on held-out rows
BAND = 0.03  # by which held-out accuracy may stay below that of the keywords
SIMILAR = 0.08  # least similarity of a document and a benchmark item
WIDE_ENTRIES = 188
SELECTED = 40  # positions of the assembled vector
VOCABULARY = dict(ngram_max=4, min_df=2, max_df=0.9, max_features=1500)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs -------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents with `lang` as `label`, spread over all slots for per-row text work."""
    rows = table(spark, sf, "documents").withColumnRenamed("lang", "label")
    return spread(rows.select("doc_id", *(columns or ("text", "label", "source", "n_chars"))), "doc_id")


def pages(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "pages").select("page_id", *columns), "page_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "text")


def lines(docs: DataFrame) -> DataFrame:
    """Slide rows of documents: one per line of text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn(
        "text", tx.strip(F.col("text"))
    )


def toxic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").filter("toxic = 1").select("doc_id")


def decks_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A deck per document; those of documents labelled toxic are damaged files."""
    docs = documents(spark, sf, "text")
    flagged = docs.join(toxic(spark, sf).withColumn("broken", F.lit(True)), "doc_id", "left")
    return document_decks(flagged.withColumn("broken", F.coalesce("broken", F.lit(False))))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword results of all documents with the true label and derived seconds."""
    docs = documents(spark, sf).withColumn("seconds", F.col("n_chars") / 1000.0)
    return classify.keyword_classify(docs, WORDS)


def with_model(df: DataFrame) -> DataFrame:
    """Class probabilities from smoothed keyword counts, and their arg-max class."""
    counted = features.keyword_features(df, WORDS, output="_n", lower_keywords=True)
    total = F.aggregate("_n", F.lit(0), lambda a, x: a + x) + len(SUBJECTS)
    shares = counted.withColumn("_total", total).withColumn(
        "probability", F.transform("_n", lambda n: (n + 1) / F.col("_total"))
    )
    return classify.model_classify(shares.drop("_n", "_total"), SUBJECTS)


def document_dictionary(spark: SparkSession, sf: str, n: int | None = None) -> DataFrame:
    return keywords.class_keywords(documents(spark, sf, "text", "label"), SUBJECTS, n).drop("n")


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    labelled = decks.label_by_folder(pages(spark, sf, "url", "html"), SUBJECTS, None, "url")
    return labelled.select("page_id", "url", "label", tx.text_runs(F.col("html"), "p").alias("text"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Processed texts, written once, as several passes read them."""
    docs = documents(spark, sf, "text").select("doc_id", tx.process_text(F.col("text")).alias("text"))
    return write_once(docs, "words")


def centroids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A linear classifier: class means of the embeddings, and minus half their squared length."""
    cells = table(spark, sf, "embeddings").select(
        F.col("label").alias("class"), F.posexplode("embedding").alias("feature", "value")
    )
    weights = cells.groupBy("class", "feature").agg(F.avg("value").alias("value"))
    shift = weights.groupBy("class").agg((F.sum(F.col("value") * F.col("value")) * -0.5).alias("value"))
    return weights, shift


def r6(col: str | Column) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# --- sources, extraction --------------------------------------------------------------------


@query
def deck_scan(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return files.filter(decks.is_deck(F.col("path"), [".html", ".htm"]))


@query
def labelled_scan(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return decks.label_by_folder(files, ["en", "fr", "de"], None)


@query
def dict_load(spark, sf):
    path = fresh_path(spark, "dictionary")
    dictionaries.save_dictionary(document_dictionary(spark, sf, 30), path)
    return dictionaries.load_dictionary(spark, path)


@query
def stopword_load(spark, sf):
    stop = tx.stopwords([*STOPWORDS_ENGLISH, *CUSTOM_STOP])
    words = documents(spark, sf, "text").select(F.explode(tx.word_tokens(F.col("text"))).alias("word"))
    return words.filter(F.col("word").isin(stop)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def slide_extract(spark, sf):
    slides = decks.slide_text(decks.extract_slides(decks_of_documents(spark, sf)), unescape=True)
    return slides.select("path", "slide_idx", "text", F.col("error").isNotNull().alias("failed"))


@query
def markup_runs(spark, sf):
    return pages(spark, sf, "html").select("page_id", tx.text_runs(F.col("html"), "p").alias("text"))


@query
def deck_text(spark, sf):
    return extraction.deck_text(turns(spark, sf), 50, "conv_id", "turn")


@query
def slide_count(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"))
    return extraction.slide_count(ids, turns(spark, sf), "conv_id")


@query
def slide_images(spark, sf):
    images = decks.extract_images(decks_of_documents(spark, sf))
    return images.select("path", "slide_idx", "img_no", "name", "ext", F.octet_length("content").alias("n_bytes"))


@query
def text_fallback(spark, sf):
    html = F.col("html")
    text = tx.first_text(tx.text_runs(html, "p"), tx.text_runs(html, "title"))
    return pages(spark, sf, "html").select("page_id", text.alias("text"))


@query
def extract_corpus(spark, sf):
    docs = documents(spark, sf, "text")
    saved = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return extraction.extract_corpus(docs, lines(docs), saved, 30, "doc_id", "line")


# --- sinks ------------------------------------------------------------------------------------


@query
def write_results_csv(spark, sf):
    rows = scored(spark, sf)
    path = fresh_path(spark, "results")
    named = rows.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    sinks.write_results(named, path)
    return rounded(sinks.read_results(spark, path), "confidence", "seconds")


@query
def write_dataset_info(spark, sf):
    labelled = decks.label_by_folder(pages(spark, sf, "url"), SUBJECTS_AND_ABSENT, None, "url")
    info = dataset.dataset_info(labelled, SUBJECTS_AND_ABSENT, path="url")
    path = fresh_path(spark, "info")
    sinks.write_dataset_info(info, path, SUBJECTS_AND_ABSENT, "pages")
    schema = (
        "subjects array<string>, data_dir string, total_files long, "
        "distribution map<string,long>, file_examples map<string,array<string>>"
    )
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("i"))
    rows = parsed.select("i", F.explode("i.distribution").alias("label", "n"))
    examples = F.coalesce(F.array_join(F.col("i.file_examples")[F.col("label")], ","), F.lit(""))
    return rows.select("label", "n", F.col("i.total_files").alias("total_files"), examples.alias("examples"))


@query
def write_mini_csv(spark, sf):
    labelled = decks.label_by_folder(pages(spark, sf, "url"), SUBJECTS, None, "url")
    path = fresh_path(spark, "mini")
    sinks.write_mini(dataset.mini_dataset(labelled, SUBJECTS, 10, id_col="page_id"), path, "url")
    return spark.read.option("header", True).schema("file_path string, label string").csv(path)


@query
def save_dictionary(spark, sf):
    path = fresh_path(spark, "dictionary")
    dictionaries.save_dictionary(document_dictionary(spark, sf, 30), path)
    return spark.read.text(path).select(F.col("value").alias("json"))


@query
def model_save_load(spark, sf):
    docs = documents(spark, sf, "text")
    path = fresh_path(spark, "model")
    sinks.save_model(features.tfidf_pipeline(features.fit_vocabulary(docs, **VOCABULARY)), path)
    loaded = sinks.load_model(path).transform(docs)
    return loaded.select("doc_id", F.size(F.filter(features.entries("tfidf"), lambda c: c["value"] > 0)).alias("terms"))


# --- text ------------------------------------------------------------------------------------


@query
def basic_clean(spark, sf):
    return documents(spark, sf, "text").select("doc_id", tx.basic_clean(F.col("text")).alias("clean"))


@query
def han_runs(spark, sf):
    runs = tx.extract_chinese(tx.basic_clean(F.col("text")), ACCENTS)
    return documents(spark, sf, "text").select(
        "doc_id", runs.alias("runs"), tx.extract_chinese(F.col("text")).alias("han")
    )


@query
def latin_words(spark, sf):
    return documents(spark, sf, "text").select("doc_id", tx.extract_english(F.col("text")).alias("words"))


@query
def english_filter(spark, sf):
    kept = tx.process_english(tx.latin_words(tx.basic_clean(F.col("text"))))
    return documents(spark, sf, "text").select("doc_id", F.array_join(kept, " ").alias("words"))


@query
def han_segment(spark, sf):
    pairs = tx.segment_chinese(tx.basic_clean(F.col("text")), chars=ACCENTS)
    return documents(spark, sf, "text").select("doc_id", F.array_join(pairs, " ").alias("pairs"))


@query
def han_lattice(spark, sf):
    """Words by the best path; letters stand in for Han as the tables have none."""
    words = tx.segment_chinese(tx.basic_clean(F.col("text")), PARTICLES, chars=LETTERS)
    return documents(spark, sf, "text").select("doc_id", F.array_join(words, " ").alias("words"))


@query
def process_text(spark, sf):
    return documents(spark, sf, "text").select(
        "doc_id",
        tx.process_text(F.col("text")).alias("text"),
        F.length(tx.process_text(F.col("text"), keep_english=False)).alias("chinese_only_chars"),
    )


@query
def segment_dict(spark, sf):
    return keywords.segment_terms(document_dictionary(spark, sf)).select("subject", "kw_ord", "keyword")


@query
def doc_keywords(spark, sf):
    return keywords.doc_keywords(documents(spark, sf, "text"), 20)


@query
def jaccard(spark, sf):
    """Similarity of every conversation turn to the turn that follows it."""
    first = turns(spark, sf)
    following = first.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = first.join(following, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", r6(tx.jaccard(F.col("text"), F.col("next_text"))).alias("similarity"))


@query
def similar_pairs(spark, sf):
    """Documents against the whole benchmark, all pairs above the threshold."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    return rounded(similarity.similar_pairs(documents(spark, sf, "text"), items, SIMILAR), "similarity")


# --- datasets ----------------------------------------------------------------------------------


def labelled_ids(spark, sf, *extra):
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), *extra)


@query
def limit_per_class(spark, sf):
    return dataset.limit_per_class(labelled_ids(spark, sf), SUBJECTS, 100, shuffle=True)


@query
def stratified_split(spark, sf):
    return dataset.stratified_split(labelled_ids(spark, sf), SUBJECTS)


@query
def class_subset(spark, sf):
    return dataset.class_subset(labelled_ids(spark, sf, "source"), "fr", SUBJECTS, 40)


@query
def class_distribution(spark, sf):
    return dataset.class_distribution(labelled_ids(spark, sf))


@query
def analyze_dataset(spark, sf):
    out = dataset.analyze_dataset(labelled_ids(spark, sf), SUBJECTS_AND_ABSENT)
    return rounded(out, "percent", "imbalance")


@query
def mini_dataset(spark, sf):
    return dataset.mini_dataset(labelled_ids(spark, sf), SUBJECTS)


@query
def dataset_info(spark, sf):
    labelled = decks.label_by_folder(pages(spark, sf, "url"), SUBJECTS_AND_ABSENT, None, "url")
    info = dataset.dataset_info(labelled, SUBJECTS_AND_ABSENT, path="url")
    return info.select("label", "n", F.array_join("examples", ",").alias("examples"))


@query
def label_encode(spark, sf):
    return dataset.label_encode(labelled_ids(spark, sf), SUBJECTS)


@query
def label_decode(spark, sf):
    coded = dataset.label_encode(labelled_ids(spark, sf), SUBJECTS)
    return dataset.label_decode(coded, SUBJECTS).drop("label")


@query
def encoded_distribution(spark, sf):
    return dataset.encoded_distribution(dataset.label_encode(labelled_ids(spark, sf), SUBJECTS), SUBJECTS)


# --- features ----------------------------------------------------------------------------------


@query
def tfidf_vocab(spark, sf):
    vocabulary = features.fit_vocabulary(documents(spark, sf, "text"), **VOCABULARY)
    return vocabulary.to_frame(spark).select("idx", "term", "tf", "df", r6(vocabulary.idf()).alias("idf"))


@query
def tfidf_transform(spark, sf):
    docs = documents(spark, sf, "text")
    vocabulary = features.fit_vocabulary(docs, **VOCABULARY)
    weighted = features.tfidf_transform(docs, vocabulary)
    cells = features.vector_entries(weighted, "tfidf", vocabulary.terms, ["doc_id"])
    return cells.select("doc_id", "term", r6("value").alias("weight"))


@query
def stat_features(spark, sf):
    out = features.stat_features(documents(spark, sf, "text"))
    ratios = ["avg_word_length", "chinese_ratio", "english_ratio", "digit_ratio"]
    return rounded(out.select("doc_id", *features.STAT_NAMES), *ratios)


def count_columns(column: str) -> list[Column]:
    return [F.get(F.col(column), F.lit(i)).alias(f"n_{s}") for i, s in enumerate(SUBJECTS)]


@query
def keyword_features(spark, sf):
    out = features.keyword_features(documents(spark, sf, "text"), MIXED_CASE)
    return out.select("doc_id", *count_columns("keyword_counts"))


@query
def embedding_attach(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id")
    out = features.attach_embeddings(ids, table(spark, sf, "embeddings"), 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", "has_embedding", F.size("embedding").alias("width"), r6(total).alias("total"))


@query
def feature_assemble(spark, sf):
    out = features.stat_features(documents(spark, sf, "text")).withColumn("stats", features.stat_array())
    out = features.keyword_features(out, WORDS)
    out = features.attach_embeddings(out, table(spark, sf, "embeddings"), 64)
    vector = features.vector_to_array("features")
    built = features.assemble(out, ["stats", "keyword_counts", "embedding"]).withColumn("v", vector)
    return built.select(
        "doc_id",
        F.size("v").alias("width"),
        F.get("v", F.lit(0)).alias("text_length"),
        F.get("v", F.lit(10)).alias("n_en"),
        r6(F.get("v", F.lit(77))).alias("last"),
    )


@query
def variance_topk(spark, sf):
    """Of the whole assembled vector: TF-IDF, statistics and keyword counts."""
    words = cleaned(spark, sf)
    model = features.fit_features(words, WORDS, processed=True)
    names = features.literal_array(model.names)
    top = features.variance_topk(model.transform(words, processed=True), SELECTED)
    return top.select("rank", F.get(names, F.col("idx")).alias("name"), F.round("variance", 4).alias("variance"))


@query
def apply_selection(spark, sf):
    words = cleaned(spark, sf)
    model = features.fit_features(words, WORDS, processed=True)
    rows = write_once(model.transform(words, processed=True).select("doc_id", "features"), "assembled")
    kept = [r.idx for r in features.variance_topk(rows, SELECTED).orderBy("rank").collect()]
    chosen = features.apply_selection(rows, kept)
    cells = chosen.select("doc_id", F.inline(features.entries("selected")))
    return cells.select("doc_id", (F.col("idx") + 1).alias("rank"), r6("value").alias("value"))


@query
def align_width(spark, sf):
    def sides(width: int) -> list[Column]:
        value = scores.align_width(F.col("embedding"), width)
        total = F.aggregate(value, F.lit(0.0), lambda a, x: a + x)
        return [F.size(value).alias(f"width_{width}"), r6(total).alias(f"total_{width}")]

    return table(spark, sf, "embeddings").select("vec_id", *sides(32), *sides(80))


@query
def feature_importance(spark, sf):
    weights, _ = centroids(spark, sf)
    names = [f"dim_{i}" for i in range(64)]
    return rounded(features.feature_importance(weights, names), "importance")


@query
def extract_features(spark, sf):
    # The text is cleaned once; vocabulary and vectors are made from the written words.
    words = cleaned(spark, sf)
    model = features.fit_features(words, WORDS, processed=True)
    out = model.transform(words, processed=True).withColumn("v", features.vector_to_array("features"))
    width = len(model.vocabulary.terms)
    weights = F.slice("v", 1, width)
    return out.select(
        "doc_id",
        F.size(F.filter(weights, lambda w: w > 0)).alias("tfidf_terms"),
        r6(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)).alias("tfidf_total"),
        F.get("v", F.lit(width)).alias("text_length"),
        F.get("v", F.lit(width + 1)).alias("word_count"),
        F.get("v", F.lit(width + 10)).alias("n_en"),
    )


@query
def extract_selected(spark, sf):
    """The same with fewer features than the vector is wide, so that fitting selects by variance."""
    words = cleaned(spark, sf)
    model = features.fit_features(words, WORDS, processed=True, cfg=TrainSettings(selected_features=SELECTED))
    cells = model.transform(words, processed=True).select("doc_id", F.inline(features.entries("features")))
    return cells.select("doc_id", F.get(features.literal_array(model.names), F.col("idx")).alias("name"), r6("value").alias("value"))


@query
def light_features(spark, sf):
    out = features.light_features(documents(spark, sf, "text"), WORDS)
    return out.select(
        "doc_id",
        F.size("light").alias("width"),
        *[F.get("light", F.lit(i)).alias(f"n_{s}") for i, s in enumerate(SUBJECTS)],
        F.aggregate("light", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


# --- classification ------------------------------------------------------------------------------


@query
def keyword_classify(spark, sf):
    docs = documents(spark, sf, "text", "label")
    return rounded(classify.keyword_classify(docs, WORDS).drop("text"), "confidence")


@query
def keyword_classify_wide(spark, sf):
    """With a dictionary of the size people use: 188 entries a class, 752 in all."""
    words = KeywordDictionary.from_frame(document_dictionary(spark, sf, WIDE_ENTRIES))
    out = classify.keyword_classify(documents(spark, sf, "text"), words).drop("text")
    return rounded(out, "confidence")


@query
def cascade_classify(spark, sf):
    docs = documents(spark, sf, "text", "label")
    return rounded(classify.cascade_classify(docs, WORDS, with_model).drop("text"), "confidence")


@query
def keyword_only(spark, sf):
    out = classify.keyword_only(turns(spark, sf), WORDS, "conv_id", "turn")
    return rounded(out.drop("text"), "confidence")


@query
def model_classify(spark, sf):
    out = with_model(documents(spark, sf, "text"))
    return out.select("doc_id", "model_subject", r6("model_confidence").alias("model_confidence"))


@query
def batch_classify(spark, sf):
    out = classify_decks(decks_of_documents(spark, sf), WORDS, unescape=True, error_as_failed=True)
    return out.select("path", "subject", r6("confidence").alias("confidence"))


@query
def incremental_classify(spark, sf):
    """Labelled documents were scored before; of those, the toxic ones changed since."""
    docs = documents(spark, sf, "text", "n_chars")
    marks = table(spark, sf, "labels").select("doc_id", "toxic")
    earlier = classify.keyword_classify(docs.join(marks, "doc_id"), WORDS)
    stored = earlier.select("doc_id", (F.col("n_chars") + F.col("toxic")).alias("n_chars"), "subject", "confidence")
    out = classify.incremental_classify(docs, stored, WORDS, ["doc_id", "n_chars"])
    return rounded(out, "confidence")


# --- training ------------------------------------------------------------------------------------


def parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with all features, written once, and whether the keywords alone hit."""
    split = dataset.stratified_split(labelled_ids(spark, sf), SUBJECTS).select("doc_id", "part")
    docs = dataset.label_encode(documents(spark, sf, "text", "label").join(split, "doc_id"), SUBJECTS)
    rows = classify.keyword_classify(docs, WORDS).select(
        "doc_id",
        "part",
        F.col("code").cast("double").alias("label"),
        (F.col("subject") == F.col("label")).alias("baseline"),
        tx.process_text(F.col("text")).alias("text"),
    )
    words = write_once(rows, "training-texts")
    model = features.fit_features(words.filter("part = 'train'"), WORDS, processed=True)
    ready = model.transform(words, processed=True).select("doc_id", "part", "label", "baseline", "features")
    ready = write_once(ready, "training-rows")
    return ready.filter("part = 'train'"), ready.filter("part = 'test'")


def held_out(scored: DataFrame, **checks: Column) -> DataFrame:
    """Per class the test rows and those the keywords hit, and whether each check holds over all of them.

    `accurate` asks for hits in no fewer rows than the keywords have, less `BAND` of all rows.
    """
    every = per_class_window()
    flags = [F.avg(c.cast("double")).alias(n) for n, c in checks.items()]
    baseline = F.sum(F.col("baseline").cast("long"))
    rows = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n_test"), baseline.alias("baseline_hits"), *flags)
    names = F.array(*[F.lit(s) for s in dataset.label_codes(SUBJECTS)])
    weights = {n: F.sum(F.col(n) * F.col("n_test")).over(every) / F.sum("n_test").over(every) for n in checks}
    floor = {"sums_to_one": F.lit(1.0), "accurate": F.sum("baseline_hits").over(every) / F.sum("n_test").over(every) - BAND}
    return rows.select(
        F.get(names, F.col("label").cast("int")).alias("label"),
        "n_test",
        "baseline_hits",
        *[(w >= floor.get(n, F.lit(FLOOR))).alias(n) for n, w in weights.items()],
    )


def hit() -> Column:
    return F.col("prediction") == F.col("label")


@query
def train_teacher(spark, sf):
    train_set, test_set = parts(spark, sf)
    teacher = training.train_teacher(train_set)
    scored = teacher.transform(test_set)
    total = F.aggregate(features.vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x)
    return held_out(scored, accurate=hit(), sums_to_one=F.abs(total - 1) < 1e-9)


@query
def train_student(spark, sf):
    train_set, test_set = parts(spark, sf)
    return held_out(training.train_student(train_set, "random_forest").transform(test_set), accurate=hit())


@query
def distill(spark, sf):
    train_set, test_set = parts(spark, sf)
    teacher = training.train_teacher(train_set)
    student = training.distill(teacher, train_set, soft=True, iterations=100)
    taught = teacher.transform(test_set).select("features", "label", "baseline", F.col("prediction").alias("teacher"))
    return held_out(student.transform(taught), agrees=F.col("prediction") == F.col("teacher"), accurate=hit())


@query
def temperature_scale(spark, sf):
    out = training.tempered(with_model(documents(spark, sf, "text")))
    return out.select("doc_id", *[r6(F.get("probability", F.lit(i))).alias(f"p_{s}") for i, s in enumerate(SUBJECTS)])


@query
def distill_eval(spark, sf):
    both = with_model(scored(spark, sf))
    return rounded(
        training.distillation_accuracy(both, "label", "subject", "model_subject"), "teacher_accuracy", "student_accuracy"
    )


@query
def agreement_rate(spark, sf):
    return rounded(training.agreement_rate(with_model(scored(spark, sf)), "subject", "model_subject"), "agreement")


@query
def topk_coef(spark, sf):
    weights, _ = centroids(spark, sf)
    return rounded(training.topk_coefficients(weights, 32), "importance")


@query
def reduced_eval(spark, sf):
    weights, shift = centroids(spark, sf)
    out = training.reduced_eval(table(spark, sf, "embeddings"), weights, shift, 32, "float32", "label", "embedding")
    return rounded(out, "full_accuracy", "reduced_accuracy", "change")


@query
def reduced_eval_half(spark, sf):
    weights, shift = centroids(spark, sf)
    out = training.reduced_eval(table(spark, sf, "embeddings"), weights, shift, 32, "float16", "label", "embedding")
    return rounded(out, "full_accuracy", "reduced_accuracy", "change")


@query
def train_job(spark, sf):
    """Accuracy of the three models against that of the keywords on the same test rows."""
    docs = documents(spark, sf, "text", "label")
    run = train(docs, SUBJECTS, WORDS, compress=True)
    split = dataset.stratified_split(labelled_ids(spark, sf), SUBJECTS).filter("part = 'test'").select("doc_id")
    known = classify.keyword_classify(docs.join(split, "doc_id", "left_semi"), WORDS)
    # One row of each side.
    base = known.agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("subject") == F.col("label")).cast("double")).alias("baseline")).first()
    return run.comparison.select(
        "model",
        F.lit(base.n_test).cast("long").alias("n_test"),
        F.round(F.lit(base.baseline), 6).alias("baseline"),
        (F.col("accuracy") >= base.baseline - BAND).alias("accurate"),
    )


# --- evaluation ------------------------------------------------------------------------------------


@query
def accuracy(spark, sf):
    return rounded(evaluate.accuracy(scored(spark, sf), prediction="subject"), "accuracy")


@query
def macro_metrics(spark, sf):
    out = evaluate.macro_metrics(scored(spark, sf), prediction="subject")
    return rounded(out, *out.columns)


@query
def class_metrics(spark, sf):
    return rounded(evaluate.class_metrics(scored(spark, sf), prediction="subject"), "precision", "recall", "f1")


@query
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(scored(spark, sf), prediction="subject")


@query
def classification_report(spark, sf):
    out = evaluate.classification_report(scored(spark, sf), prediction="subject")
    return rounded(out, "precision", "recall", "f1")


@query
def compare_models(spark, sf):
    both = with_model(scored(spark, sf))
    long = both.select(
        "label",
        F.inline(
            F.array(
                F.struct(F.lit("keyword").alias("model"), F.col("subject").alias("prediction")),
                F.struct(F.lit("counts").alias("model"), F.col("model_subject").alias("prediction")),
            )
        ),
    )
    return rounded(evaluate.compare_models(long), "accuracy", "f1_macro")


def errors(spark, sf):
    rows = with_model(scored(spark, sf))
    return evaluate.analyze_errors(rows, classes=SUBJECTS, probability="probability", prediction="model_subject")


@query
def analyze_errors(spark, sf):
    return rounded(errors(spark, sf), "true_prob", "pred_prob")


@query
def top_errors(spark, sf):
    return evaluate.top_errors(errors(spark, sf), 20)


# --- dictionaries and reports ------------------------------------------------------------------------


@query
def class_keywords(spark, sf):
    return keywords.class_keywords(documents(spark, sf, "text", "label"), SUBJECTS, 30).select(
        "subject", "kw_ord", "keyword", "n"
    )


@query
def merge_dict(spark, sf):
    new = keywords.class_keywords(page_texts(spark, sf), SUBJECTS, None)
    old = document_dictionary(spark, sf)
    return keywords.merge_dictionaries(old, new, WORDS.to_frame(spark), SUBJECTS).drop("subject_ord")


@query
def keyword_hit_rate(spark, sf):
    docs = documents(spark, sf, "text", "label")
    return rounded(keywords.keyword_hit_rate(docs, MIXED_CASE), "hit_rate")


@query
def dict_stats(spark, sf):
    out = keywords.dictionary_stats(document_dictionary(spark, sf))
    return rounded(out.withColumn("examples", F.array_join("examples", ",")), "avg_length")


@query
def ambiguous_keywords(spark, sf):
    out = keywords.ambiguous_keywords(document_dictionary(spark, sf))
    return out.withColumn("subjects", F.array_join("subjects", ","))


@query
def dict_export(spark, sf):
    return keywords.export_described(document_dictionary(spark, sf), DESCRIPTIONS)


@query
def subject_report(spark, sf):
    return rounded(report.subject_report(scored(spark, sf), SUBJECTS), "percent")


@query
def confidence_summary(spark, sf):
    out = report.confidence_summary(scored(spark, sf))
    return rounded(out, *out.columns)


@query
def confidence_histogram(spark, sf):
    rows = with_model(documents(spark, sf, "text")).select(
        F.col("model_subject").alias("subject"), F.col("model_confidence").alias("confidence")
    )
    return rounded(report.confidence_histogram(rows, with_overflow=False), "percent")


@query
def timing_summary(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("n_chars") / 1000.0).alias("seconds"))
    out = report.timing_summary(rows)
    return rounded(out, *[c for c in out.columns if c != "files"])


@query
def confidence_band(spark, sf):
    band = scores.confidence_band(F.col("confidence")).alias("band")
    return scored(spark, sf).select("doc_id", band)
