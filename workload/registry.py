"""One query per operator, over whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope import schemas

from chatterscope.functions import accounts as ac
from chatterscope.functions import text as tx
from chatterscope.operators import abbreviations as abbr
from chatterscope.operators import activity as act
from chatterscope.operators import checks, duplicates, entities, gates, keyed, merge
from chatterscope.operators.sentiment import sentiment, sentiment_words
from chatterscope.params import REPORT_PRESET
from chatterscope.plans import comments as cp
from chatterscope.plans import ingest as ing
from chatterscope.plans import submissions as sp
from chatterscope.plans import users as up
from chatterscope.sources import landing, reports, snapshots, tables
from chatterscope.streaming import activity as activity_stream
from chatterscope.streaming import comments as comment_stream
from chatterscope.streaming import load
from workload import projections as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Scans and lookups


@query
def comments_scan(spark, sf):
    return tables.comments_scan(P.comments(spark, sf))


@query
def users_scan(spark, sf):
    return tables.users_scan(P.users(spark, sf))


@query
def submissions_join(spark, sf):
    return sp.submissions_of_known_users(P.submissions(spark, sf), P.users(spark, sf))


@query
def submissions_by_author(spark, sf):
    return tables.submissions_by_author(P.submissions(spark, sf), "Customer#000000007")


@query
def comments_by_link(spark, sf):
    return tables.comments_by_submission(P.comments(spark, sf), "p7")


@query
def communities_appended(spark, sf):
    """Listings of two communities, appended; a post in both stays twice."""
    posts = P.submissions(spark, sf)
    wanted = landing.split_communities("news+nsfw")
    kinds = {"news": F.lit(True), "nsfw": F.col("over_18")}
    parts = [posts.where(kinds[w]).withColumn("community", F.lit(w)) for w in wanted]
    return parts[0].unionByName(parts[1])


@query
def communities_landed(spark, sf):
    """The same listings, landed as lines in a folder for each community and read as one list of paths."""
    posts = P.submissions(spark, sf)
    root = load.checkpoint_folder(spark, f"communities-{uuid.uuid4()}", spark.conf.get("spark.sql.warehouse.dir"))
    for name, kept in (("news", F.lit(True)), ("nsfw", F.col("over_18"))):
        reports.write_lines(posts.where(kept), f"{root}/{name}")
    records = landing.read_lines(spark, landing.community_paths(root, "news+nsfw"))
    return landing.to_submission_rows(landing.parse_submissions(records))


# Landing


COMMENT_COLUMNS = (
    "comment_id", "comment_author", "comment_created_utc", "body", "comment_score",
    "is_submitter", "edited", "link_id",
)
_FIELDS = ", ".join(f"'{c}', {c}" for c in COMMENT_COLUMNS if c not in ("comment_created_utc", "edited"))
# A comment as landed. What JSON shows for `edited`, a bare false, true, number or null, is put in as
# it is; the rest is written, and escaped, by the JSON writer.
_COMMENT_JSON = f"""concat('{{"edited": ', coalesce(edited_raw, 'null'), ', ', substring(to_json(named_struct(
  {_FIELDS}, 'comment_created_utc', cast(comment_created_utc as double)), map('ignoreNullFields', 'false')), 2))"""


# The same by an unknown user, under another id.
_OTHER_JSON = _COMMENT_JSON.replace("'comment_id', comment_id", "'comment_id', concat('d', substring(comment_id, 2))").replace(
    "'comment_author', comment_author", "'comment_author', 'ghost_0'"
)


def _stretch(text: Column, file: str, row: Column) -> list[Column]:
    """The columns of landed text as it is read: a stretch, its file, its place there."""
    name = F.lit(file).alias("file")
    place = F.struct(name, F.lit(0).cast("bigint").alias("start"), row.alias("row"))
    return [text.alias("value"), name, place.alias("place")]


def _number(column: str) -> Column:
    return F.regexp_extract(column, r"(\d+)$", 1).cast("bigint")


def _post_lines(spark, sf):
    """A line of landed text for each raw comment: a record of the submission it links to, with the
    comment in it. Submissions have distinct ids here, so all comments count."""
    raw = P.comments_raw(spark, sf).withColumn("_json", F.expr(_COMMENT_JSON))
    head = F.to_json(F.struct(F.col("comment_id").alias("submission_id"), F.col("comment_author").alias("author")))
    record = F.concat(F.expr("rtrim('}', _head)"), F.lit(', "comments": ['), F.col("_json"), F.lit("]}"))
    return raw.withColumn("_head", head).select(*_stretch(record, "posts", _number("comment_id")))


@query
def landing_comments(spark, sf):
    """All raw comments through landed lines, parsed, and those by people kept."""
    posts = landing.parse_submissions(landing.lines(_post_lines(spark, sf)))
    return landing.written_by_people(landing.flatten_comments(posts)).select(*COMMENT_COLUMNS)


@query
def landing_objects(spark, sf):
    """All raw comments as entries of JSON objects in several layouts: as a harvest indents them, with
    the separator cut off; compact; indented otherwise; with empty and null entries among them."""
    raw = P.comments_raw(spark, sf).withColumn("_json", F.expr(_COMMENT_JSON)).withColumn("_k", _number("comment_id"))
    key = F.concat(F.lit('"'), F.col("comment_id"), F.lit('": '))
    layout = F.col("_k") % 4
    text = (
        F.when(layout == 0, F.concat(F.lit(",\n    "), key, F.expr("rtrim('}', _json)")))
        .when(layout == 1, F.concat(F.lit("{"), key, F.col("_json"), F.lit(',"none":null,"empty":{}}\n')))
        .when(layout == 2, F.concat(F.lit('{\n  "empty": {},\n  '), key, F.col("_json"), F.lit("\n}\n")))
        .otherwise(F.concat(F.lit('{"none": null, '), key, F.expr("rtrim('}', _json)")))
    )
    found = landing.entries(raw.select(*_stretch(text, "objects", F.col("_k"))))
    return found.groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.get_json_object("json", "$.body")).alias("body"),
        F.max(F.get_json_object("json", "$.edited")).alias("edited"),
    )


@query
def landing_rejects(spark, sf):
    """Every landed line, some cut short or no objects: what cannot be read, with the reason."""
    lines = _post_lines(spark, sf)
    k = F.col("place.row")
    value = (
        F.when(k % 7 == 0, F.expr("substring(value, 1, length(value) - 5)")).when(k % 7 == 1, "null")
        .when(k % 7 == 2, F.concat(F.lit("["), "value", F.lit("]"))).when(k % 7 == 3, "  ").otherwise(F.col("value"))
    )
    records = landing.lines(lines.withColumn("value", value))
    rejected = landing.rejected_records(records, schemas.LANDED_SUBMISSION)
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


def _landed_users(spark, sf):
    """Users as landed profile records, parsed by the library."""
    users = P.users(spark, sf)
    number = _number("redditor")
    profile = users.select(
        F.to_json(
            F.struct(
                F.when(number % 19 != 0, F.col("redditor_id")).alias("redditor_id"),
                F.when(number % 31 == 0, "Deleted").otherwise(F.col("redditor")).alias("redditorname"),
                F.when(number % 37 != 0, F.col("created_utc").cast("double")).alias("created_utc"),
                F.when(number % 41 != 0, F.col("link_karma")).alias("link_karma"),
                "comment_karma", "total_karma", "is_employee", "is_mod", "is_gold",
                F.col("dormant_days").cast("double").alias("dormant_days"),
                F.when(F.col("has_verified_email"), True).alias("has_verified_email"),
                F.col("accepts_followers").alias("accept_followers"),
                "redditor_is_subscriber",
                (number % 26 == 0).alias("user_is_moderator"),
            )
        ).alias("json")
    )
    return landing.parse_users(profile)


@query
def landing_users(spark, sf):
    kept = landing.with_flag_defaults(landing.harvestable(_landed_users(spark, sf)))
    return landing.to_user_rows(landing.with_id(kept))


@query
def landing_users_rejected(spark, sf):
    return landing.rejected_users(_landed_users(spark, sf)).select("redditorname", "total_karma")


@query
def landing_submissions(spark, sf):
    """Submissions through JSON and back, with the label for a missing author."""
    posts = P.submissions(spark, sf).select(F.to_json(F.struct("*")).alias("json"))
    return landing.to_submission_rows(landing.with_author_label(landing.parse_submissions(posts)))


@query
def submissions_as_lines(spark, sf):
    """Submissions written as newline-delimited records to the shared folder, and read again."""
    folder = load.checkpoint_folder(spark, f"lines-{uuid.uuid4()}", spark.conf.get("spark.sql.warehouse.dir"))
    reports.write_lines(P.submissions(spark, sf), folder)
    return landing.to_submission_rows(landing.parse_submissions(landing.read_lines(spark, [folder])))


@query
def submissions_as_object(spark, sf):
    """Submissions written as one indented object by their id, by many tasks, and read again."""
    folder = load.checkpoint_folder(spark, f"object-{uuid.uuid4()}", spark.conf.get("spark.sql.warehouse.dir"))
    reports.write_indented(P.submissions(spark, sf), "submission_id", folder)
    records = landing.read_indented(spark, reports.indented_parts(folder))
    return landing.to_submission_rows(landing.parse_submissions(records))


#: Small, so that the given tables fall into many blocks too.
_BLOCK_BYTES = 200_000


@query
def landing_any_layout(spark, sf):
    """All raw comments as entries of compact objects, a hundred or so a line, and of indented ones, cut
    into records by many tasks that begin anywhere in them."""
    raw = P.comments_raw(spark, sf).withColumn("_json", F.expr(_COMMENT_JSON)).withColumn("_k", _number("comment_id"))
    folder = load.checkpoint_folder(spark, f"layouts-{uuid.uuid4()}", spark.conf.get("spark.sql.warehouse.dir"))
    entry = F.concat(F.lit('"'), F.col("comment_id"), F.lit('":'), F.col("_json"))
    lines = raw.where("_k % 2 = 0").groupBy(F.floor(F.col("_k") / 200)).agg(F.array_join(F.collect_list(entry), ",").alias("_e"))
    lines.select(F.concat(F.lit("{"), "_e", F.lit("}"))).write.option("lineSep", " ").text(f"{folder}/compact")
    reports.write_indented(raw.where("_k % 2 = 1").drop("_json", "_k"), "comment_id", f"{folder}/indented")
    splitting = spark.newSession()
    splitting.conf.set("spark.sql.files.maxPartitionBytes", _BLOCK_BYTES)
    found = landing.read_objects(splitting, [f"{folder}/compact", *reports.indented_parts(f"{folder}/indented")])
    text = lambda name: F.get_json_object("json", f"$.{name}").alias(name)
    return found.select(F.col("key").alias("comment_id"), text("comment_author"), text("body"), text("link_id"))


# The whole load


def _users_landed(spark, sf):
    """A line for each user; one in nineteen lacks an id."""
    users = P.users(spark, sf)
    number = _number("redditor")
    profile = F.to_json(
        F.struct(
            F.when(number % 19 != 0, F.col("redditor_id")).alias("redditor_id"), F.col("redditor").alias("redditorname"),
            *(c for c in users.columns if c not in ("redditor_id", "redditor", "accepts_followers")),
            F.col("accepts_followers").alias("accept_followers"),
        )
    )
    return landing.lines(users.select(*_stretch(profile, "users", number)))


def _posts_landed(spark, sf):
    """A submission for each raw comment, with that comment and one by an unknown user; one in ten
    stands twice, the second time in a later file with another body."""
    raw = P.comments_raw(spark, sf)

    def lines_of(rows, file):
        both = rows.withColumns({"_json": F.expr(_COMMENT_JSON), "_other": F.expr(_OTHER_JSON)})
        head = F.to_json(F.struct(F.concat(F.lit("s"), _number("comment_id")).alias("submission_id"), F.col("comment_author").alias("author")))
        record = F.concat(
            F.expr("rtrim('}', _head)"), F.lit(', "comments": ['), F.col("_json"), F.lit(", "), F.col("_other"), F.lit("]}")
        )
        return both.withColumn("_head", head).select(*_stretch(record, file, _number("comment_id")))

    again = raw.where(_number("comment_id") % 10 == 0).withColumn("body", F.concat("body", F.lit(" (again)")))
    return landing.lines(lines_of(raw, "posts-1").unionByName(lines_of(again, "posts-2")))


def _landed(spark, sf):
    return ing.parse_landing(_users_landed(spark, sf), _posts_landed(spark, sf))


def _stored(spark, sf):
    """Tables before the load: no users or submissions, and the comments with a negative score."""
    return ing.Tables(tables.empty_table(spark, "users"), tables.empty_table(spark, "submissions"), _stored_comments(spark, sf))


@query
def ingest_row(spark, sf):
    """The comments after a load with the row gate, from landed text on."""
    return ing.ingest(_landed(spark, sf), _stored(spark, sf), "row").comments


@query
def ingest_group(spark, sf):
    return ing.ingest(_landed(spark, sf), _stored(spark, sf), "group").comments


@query
def ingest_users(spark, sf):
    return ing.ingest(_landed(spark, sf), _stored(spark, sf), "row").users


@query
def ingest_submissions(spark, sf):
    posts = ing.ingest(_landed(spark, sf), _stored(spark, sf), "row").submissions
    return posts.select("submission_id", "author", "title", "submission_score")


# Keys and merges


@query
def submissions_latest(spark, sf):
    """Re-posts take the id of the original: the later record of an id stands."""
    posts = P.submissions(spark, sf).withColumn("submission_id", F.regexp_replace("submission_id", "^r", "p"))
    return landing.latest_submissions(posts, [F.col("submission_created_utc").desc()])


@query
def users_latest(spark, sf):
    """Profiles sighted as submission and comment authors: who keeps which sighting."""
    posted = P.submissions(spark, sf).select(
        F.col("author").alias("name"), F.lit("submission").alias("role"),
        F.col("submission_created_utc").alias("seq"), F.col("submission_id").alias("sighting"),
    )
    said = P.comments(spark, sf).select(
        F.col("comment_author").alias("name"), F.lit("comment").alias("role"),
        F.col("comment_created_utc").alias("seq"), F.col("comment_id").alias("sighting"),
    )
    return keyed.profiles(posted.unionByName(said).where(F.col("name").isNotNull()))


@query
def upsert_users(spark, sf):
    """Even users are stored; odd ones and every third arrive with more karma, every third twice, with
    the second time last."""
    users = P.users(spark, sf)
    number = _number("redditor")
    times = F.sequence(F.lit(1), F.when(number % 3 == 0, 2).otherwise(1))
    batch = users.where((number % 2 == 1) | (number % 3 == 0)).withColumn("seq", F.explode(times))
    batch = batch.withColumn("total_karma", F.col("total_karma") + F.col("seq") * 10)
    return merge.upsert_users(users.where(number % 2 == 0), batch, [F.col("seq").desc()])


@query
def upsert_submissions(spark, sf):
    """Stored posts, and a batch that re-posts some of them under their old ids."""
    posts = P.submissions(spark, sf)
    stored = posts.where(F.col("submission_id").startswith("p"))
    batch = posts.where(F.col("submission_id").startswith("r")).withColumn(
        "submission_id", F.regexp_replace("submission_id", "^r", "p")
    )
    return merge.upsert(stored, batch, "submission_id", [F.col("submission_created_utc").desc()])


@query
def upsert_comments(spark, sf):
    """Stored comments plus the new ones by known users."""
    comments, stored = P.peoples_comments(spark, sf), _stored_comments(spark, sf)
    new = gates.admit_comments(comments, _names(spark, sf), stored, "row", group="link_id")
    return merge.upsert(stored, new, "comment_id", [F.col("comment_created_utc").desc()])


def _versions(spark, sf):
    """Comments stored as one version, and the new ones by known users loaded as the next."""
    folder = load.checkpoint_folder(spark, f"versions-{uuid.uuid4()}", spark.conf.get("spark.sql.warehouse.dir"))
    versions = snapshots.Snapshots(spark, folder, buckets=16)
    comments, stored = P.peoples_comments(spark, sf), _stored_comments(spark, sf)
    versions.load({"comments": snapshots.Updates(stored, [F.col("comment_created_utc").desc()])})
    new = gates.admit_comments(comments, _names(spark, sf), versions.read("comments"), "row", group="link_id")
    versions.load({"comments": snapshots.Updates(new, [F.col("comment_created_utc").desc()])})
    return versions


@query
def upsert_incremental(spark, sf):
    """The merge of `upsert_comments` as a load into versioned tables: the last version."""
    return _versions(spark, sf).read("comments")


@query
def version_before(spark, sf):
    """The same tables as they were before the last load."""
    return _versions(spark, sf).read("comments", 1)


@query
def load_versions(spark, sf):
    """A whole load of landed text into versioned tables, twice: the rows of each table and version. The
    second load finds its comments stored."""
    folder = load.checkpoint_folder(spark, f"loads-{uuid.uuid4()}", spark.conf.get("spark.sql.warehouse.dir"))
    versions = snapshots.Snapshots(spark, folder, buckets=16)
    versions.load({"comments": snapshots.Updates(_stored_comments(spark, sf))})
    for _ in range(2):
        ing.load(_landed(spark, sf), versions, "row")
    tables_of = [versions.read(name, v).select(F.lit(v).alias("version"), F.lit(name).alias("name")) for v in (2, 3) for name in schemas.TABLES]
    return reduce(DataFrame.unionByName, tables_of).groupBy("version", "name").agg(F.count("*").alias("n"))


@query
def name_clashes(spark, sf):
    """Author names held by more than one post (the uniqueness check, on data that violates it)."""
    return checks.duplicate_keys(P.submissions(spark, sf), "author")


def _stored_comments(spark, sf):
    """Comments stored before: those with a negative score, and all under every fifth submission, so that
    nothing new opens the group gate there."""
    return P.peoples_comments(spark, sf).where((F.col("comment_score") < 0) | (_number("link_id") % 5 == 0))


def _names(spark, sf):
    return P.users(spark, sf).select("redditor")


@query
def submissions_known_row(spark, sf):
    return gates.admit_submissions(P.submissions(spark, sf), _names(spark, sf), "row")


@query
def submissions_known_group(spark, sf):
    return gates.admit_submissions(P.submissions(spark, sf), _names(spark, sf), "group")


@query
def comments_known_row(spark, sf):
    return gates.admit_comments(
        P.peoples_comments(spark, sf), _names(spark, sf), _stored_comments(spark, sf), "row", group="link_id"
    ).select("comment_id", "comment_author", "link_id")


@query
def comments_known_group(spark, sf):
    return gates.admit_comments(
        P.peoples_comments(spark, sf), _names(spark, sf), _stored_comments(spark, sf), "group", group="link_id"
    ).select("comment_id", "comment_author", "link_id")


@query
def comments_new(spark, sf):
    return gates.new_comments(P.peoples_comments(spark, sf), _stored_comments(spark, sf)).select("comment_id", "comment_author")


# Text


@query
def dup_comments(spark, sf):
    flagged = duplicates.flag_duplicates(P.comments(spark, sf).select("comment_id", "body"), ["body"], "comment_id")
    return flagged.select("comment_id", duplicates.yes_no(F.col("is_duplicate")).alias("is_duplicate"))


@query
def dup_submissions(spark, sf):
    posts = P.submissions(spark, sf).select("submission_id", "author", "title", "url")
    return duplicates.flag_duplicates(posts, ["author", "title", "url"], "submission_id").select("submission_id", "is_duplicate")


@query
def distinct_bodies(spark, sf):
    return cp.distinct_bodies(P.comments(spark, sf)).select("text")


@query
def cleaned_bodies(spark, sf):
    return P.comments(spark, sf).select("comment_id", tx.cleaned(F.col("body")).alias("cleaned"))


@query
def title_tokens(spark, sf):
    toks = tx.tokens(F.col("title"))
    return P.submissions(spark, sf).select("submission_id", F.array_join(toks, "\n").alias("tokens"))


@query
def body_tokens(spark, sf):
    toks = tx.tokens(F.col("body"))
    return P.comments(spark, sf).select(
        "comment_id", F.size(toks).cast("bigint").alias("n_tokens"), F.md5(F.array_join(toks, "\n")).alias("tokens_md5")
    )


@query
def abbreviations(spark, sf):
    """Words of the comments that end in a period somewhere, and which of them are abbreviations."""
    found = abbr.scored_words(P.comments(spark, sf), "body")
    return found.select("word", "n", "stopped", F.round("score", 6).alias("score"), (F.col("score") >= abbr.THRESHOLD).alias("abbreviation"))


@query
def kept_tokens(spark, sf):
    """Tokens with the periods of abbreviations learned from the same comments. The invented words of the
    given texts hold few, so the query's threshold is low."""
    comments = P.comments(spark, sf)
    found = abbr.kept_tokens(comments, abbr.abbreviations(comments, "body", P.ABBREVIATION), "comment_id", "body")
    return found.select(
        "comment_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", "\n")).alias("tokens_md5")
    )


@query
def sentiment_word_lists(spark, sf):
    words = sentiment_words(F.col("body"))
    return P.comments(spark, sf).select("comment_id", F.md5(F.array_join(words, "\n")).alias("words_md5"))


@query
def lexdiv_comments(spark, sf):
    ld = tx.lexical_diversity(F.col("body"))
    return P.comments(spark, sf).select("comment_id", ld.alias("ld")).select(
        "comment_id", F.col("ld.score").alias("score"),
        tx.scored(F.col("ld.score"), 2, F.col("ld.label")).alias("lexical_diversity"),
    )


@query
def lexdiv_titles(spark, sf):
    return P.submissions(spark, sf).select(
        "submission_id", tx.distinct_ratio(tx.tokens(F.col("title"))).alias("lexical_diversity")
    )


@query
def bigrams(spark, sf):
    return P.comments(spark, sf).select(
        "comment_id", tx.leading_bigrams(tx.opening_tokens(F.col("body"))).alias("common_bigrams")
    )


def _sentiment(texts, spark, sf, key, text):
    found = sentiment(texts, P.lexicon(spark, sf), key, text, P.RULES)
    compound = F.coalesce("compound", F.lit(0.0))
    return texts.select(key).join(found, key, "left").select(
        key, compound.alias("compound"),
        tx.scored(compound, 3, tx.sentiment_label(compound)).alias("sentiment"),
    )


@query
def sentiment_comments(spark, sf):
    return _sentiment(P.comments(spark, sf), spark, sf, "comment_id", "body")


@query
def sentiment_titles(spark, sf):
    return _sentiment(P.submissions(spark, sf), spark, sf, "submission_id", "title")


@query
def entities_comments(spark, sf):
    texts = P.comments(spark, sf)
    found = entities.entities(texts, P.gazetteer(spark, sf), "comment_id", "body")
    return texts.select("comment_id").join(found, "comment_id", "left").select(
        "comment_id", entities.as_words(F.col("entities")).alias("named_entities")
    )


@query
def entities_titles(spark, sf):
    texts = P.submissions(spark, sf)
    found = entities.entities(texts, P.gazetteer(spark, sf), "submission_id", "title")
    return texts.select("submission_id").join(found, "submission_id", "left").select(
        "submission_id", entities.as_brackets(F.col("entities")).alias("named_entities")
    )


def _word_runs(spark, sf):
    """Every run of two or three words of the benchmark passages: phrases that overlap each other."""
    passages = P.table(spark, sf, "benchmark").select(tx.tokens(F.col("text")).alias("t"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.slice("t", i, 2 + i % 2))
    runs = passages.where(F.size("t") > 0).select(F.explode(cuts).alias("p")).where(F.size("p") > 1)
    return runs.select(F.array_join("p", " ").alias("phrase")).distinct().withColumn("label", F.lit("RUN"))


@query
def entities_scanned(spark, sf):
    """Overlapping phrases as a scan from the left takes them."""
    texts = P.comments(spark, sf)
    found = entities.entities(texts, _word_runs(spark, sf), "comment_id", "body", overlap="kept")
    return texts.select("comment_id").join(found, "comment_id", "left").select(
        "comment_id", entities.as_words(F.col("entities")).alias("named_entities")
    )


@query
def entity_shapes(spark, sf):
    runs = entities.shape_entities(F.col("title"))
    return P.submissions(spark, sf).select("submission_id", F.array_join(runs, ", ").alias("named_entities"))


@query
def entity_shapes_comments(spark, sf):
    runs = entities.shape_entities(F.col("body"))
    return P.comments(spark, sf).select("comment_id", F.array_join(runs, ", ").alias("named_entities"))


_DIGIT = re.compile("[0-9]")


def _digit_tagger(batches):
    """A stand-in for a user's tagger: words with a digit, in text order."""
    for pdf in batches:
        hits = [
            (key, pos, word, "NUMBER")
            for key, text in zip(pdf["text_key"], pdf["text"])
            for pos, word in enumerate(w for w in text.split() if _DIGIT.search(w))
        ]
        if hits:
            yield pd.DataFrame(hits, columns=["text_key", "pos", "phrase", "label"])


@query
def entities_plugged(spark, sf):
    texts = P.comments(spark, sf)
    found = entities.plugged_entities(texts, _digit_tagger, "comment_id", "body")
    return texts.select("comment_id").join(found, "comment_id", "left").select(
        "comment_id", entities.as_words(F.col("entities")).alias("named_entities")
    )


def _failing_tagger(batches):
    """The same, but it fails on every text with a seventh length."""
    for batch in batches:
        if (batch["text"].str.len() % 7 == 0).any():
            raise ValueError("this tagger has its bad days")
        yield from _digit_tagger(iter([batch]))


@query
def failing_texts(spark, sf):
    """The comment analysis with a tagger that fails on some texts: only those show it."""
    analysed = cp.comment_analysis(P.comments(spark, sf), P.lexicon(spark, sf), P.gazetteer(spark, sf), P.RULES, _failing_tagger)
    return analysed.select("comment_id", "sentiment", "named_entities", "lexical_diversity", "common_bigrams")


# Activity and accounts


@query
def newest_per_user(spark, sf):
    return act.newest_activity(P.activity(spark, sf), P.HARVEST_LIMITS)


@query
def activity_of_users(spark, sf):
    return act.activity_of_users(P.activity(spark, sf), P.users(spark, sf))


@query
def activity_log(spark, sf):
    return act.activity_log(P.comments(spark, sf), P.submissions(spark, sf))


@query
def top_submissions(spark, sf):
    posts = P.submissions(spark, sf).withColumn("community", F.substring("submission_id", -1, 1))
    return keyed.listing(posts, "community", "top", 25)


@query
def new_submissions(spark, sf):
    posts = P.submissions(spark, sf).withColumn("community", F.substring("submission_id", -1, 1))
    return keyed.listing(posts, "community", "new", 25)


@query
def first_activity(spark, sf):
    return act.first_activity(P.activity(spark, sf))


@query
def first_harvested_activity(spark, sf):
    """As a harvest of so many items for each user would see it."""
    return act.first_activity(P.activity(spark, sf), P.HARVEST_LIMITS)


@query
def dormancy(spark, sf):
    return act.dormancy(P.users(spark, sf), P.activity(spark, sf), P.AS_OF)


@query
def account_age(spark, sf):
    return P.users(spark, sf).select("redditor_id", ac.account_age(F.col("created_utc"), P.AS_OF).alias("account_age"))


@query
def low_karma(spark, sf):
    return P.users(spark, sf).select("redditor_id", ac.low_karma(F.col("total_karma"), REPORT_PRESET.karma).alias("low_karma"))


@query
def young_accounts(spark, sf):
    age = ac.account_age(F.col("created_utc"), P.AS_OF)
    young = ac.young_account(age, REPORT_PRESET.account_age_years)
    return P.users(spark, sf).select("redditor_id", young.alias("young_account"))


@query
def account_flags(spark, sf):
    return up.account_measures(P.users(spark, sf), REPORT_PRESET, P.AS_OF).select(
        "redditor_id", F.array_join("flags", "|").alias("flags")
    )


@query
def bursts(spark, sf):
    return act.bursts(P.activity(spark, sf), REPORT_PRESET.inactivity_days, REPORT_PRESET.burst_days)


# Streams


def _folder(spark: SparkSession, name: str) -> str:
    return load.checkpoint_folder(spark, f"{name}-{uuid.uuid4()}", spark.conf.get("spark.sql.warehouse.dir"))


@query
def stream_bursts(spark, sf):
    """Bursts whose time was over when a stream of all activity ended, one day behind its newest time."""
    feed, out, check = (_folder(spark, f"bursts-{part}") for part in ("feed", "starts", "check"))
    P.activity(spark, sf).write.parquet(feed)
    activity_stream.burst_stream(
        activity_stream.activity_stream(spark, feed), out, check, REPORT_PRESET.inactivity_days, REPORT_PRESET.burst_days, "1 day"
    ).awaitTermination()
    return activity_stream.closed_bursts(spark, out)


@query
def stream_comments(spark, sf):
    """Comments delivered twice, every tenth with another text at first, streamed into a versioned table."""
    feed, root, check = (_folder(spark, f"comments-{part}") for part in ("feed", "store", "check"))
    other = (F.col("_delivery") == 1) & (F.pmod(F.xxhash64("comment_id"), F.lit(10)) == 0)
    twice = P.comments(spark, sf).withColumn("_delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    told = twice.withColumn("body", F.when(other, F.concat("body", F.lit(" (first)"))).otherwise(F.col("body")))
    ordered = told.repartitionByRange("comment_created_utc").sortWithinPartitions("comment_created_utc", "comment_id", "_delivery")
    ordered.drop("_delivery").write.parquet(feed)
    store = snapshots.Snapshots(spark, root, buckets=8)
    comment_stream.merge_stream(comment_stream.comment_stream(spark, feed), store, "comments", check, "30 days").awaitTermination()
    return store.read("comments")


# Reports


@query
def comment_report(spark, sf):
    analysis = cp.comment_analysis(P.comments(spark, sf), P.lexicon(spark, sf), P.gazetteer(spark, sf), P.RULES)
    return reports.sheet(analysis, reports.COMMENT_HEADERS)


@query
def comment_report_per_text(spark, sf):
    analysis = cp.comment_analysis_per_text(P.comments(spark, sf), P.lexicon(spark, sf), P.gazetteer(spark, sf), P.RULES)
    return reports.sheet(analysis, reports.COMMENT_HEADERS)


@query
def submission_report(spark, sf):
    analysis = sp.submission_report(
        P.submissions(spark, sf), P.users(spark, sf), P.lexicon(spark, sf), P.gazetteer(spark, sf), P.RULES
    )
    return reports.sheet(analysis, reports.SUBMISSION_HEADERS)


@query
def user_report(spark, sf):
    analysis = up.user_analysis(P.users(spark, sf), P.activity(spark, sf), REPORT_PRESET, P.AS_OF)
    return reports.sheet(analysis, reports.USER_HEADERS)


@query
def user_bursts(spark, sf):
    analysis = up.user_analysis(P.users(spark, sf), P.activity(spark, sf), REPORT_PRESET, P.AS_OF)
    return analysis.select("redditor_id", "burst_activity", "burst_count", "max_burst_size")


@query
def load_counts(spark, sf):
    """Rows a load finds, accepts, keeps and rejects; every hundredth post cannot be read."""
    return ing.load_counts(ing.parse_landing(_users_landed(spark, sf), _posts_some_cut(spark, sf)))


def _posts_some_cut(spark, sf):
    cut = F.when(F.col("place.row") % 100 == 1, F.expr("substring(json, 1, length(json) - 2)")).otherwise(F.col("json"))
    return _posts_landed(spark, sf).withColumn("json", cut)


def _counted_load(spark, sf):
    store = snapshots.Snapshots(spark, _folder(spark, "counted"), buckets=16)
    store.load({"comments": snapshots.Updates(_stored_comments(spark, sf))})
    ing.load_counted(_users_landed(spark, sf), _posts_some_cut(spark, sf), store, "row")
    return store


@query
def load_counters(spark, sf):
    """The same counts, taken while the landed records of a load were stored, from the published versions."""
    return _counted_load(spark, sf).counters().select("what", "n")


@query
def load_counted(spark, sf):
    """The users that this load leaves."""
    return _counted_load(spark, sf).read("users")


@query
def cleared_comments(spark, sf):
    """What a load into a cleared table leaves there."""
    empty = tables.empty_table(spark, "comments")
    return merge.upsert(empty, P.comments(spark, sf), "comment_id", [F.col("comment_created_utc").desc()])
