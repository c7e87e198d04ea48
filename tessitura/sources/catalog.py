"""Readers and writers of catalog documents, snapshots and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.states import ACTIVE
from tessitura.functions.text import trimmed
from tessitura.functions.titles import with_guess
from tessitura.operators.browse import numbered
from tessitura.sources.publish import publish, published

JOB = (
    "id string, url string, webpage_url string, title string, track string, artist string, thumbnail string, duration double, state string, step string, "
    "progress int, message string, error string, language string, stems struct<instrumental:string,vocals:string>, lyrics_file string, line_count int, "
    "lyrics_status string, lyrics_source string, video_id string, local_path string, "
    "recordings array<struct<file:string,title:string,duration:double,created_at:double,size:bigint,mime_type:string>>, "
    "created_at double, updated_at double, generation string"
)
ROOM = (
    "id string, created_at double, updated_at double, revision int, name string, host string, pair string, controllers array<string>, "
    "queue array<struct<id:string,job_id:string>>, current struct<id:string,job_id:string>, "
    "playback struct<playing:boolean,guide:boolean,position:double,seek_version:int>, commands array<array<string>>"
)
#: Fields without which a room isn't restored; `current` may be null.
ROOM_KEYS = ("id", "created_at", "updated_at", "host", "pair", "controllers", "queue", "current", "playback", "revision", "commands")
MEDIA = ("mp3", "m4a", "flac", "wav", "ogg", "opus", "mp4", "mkv", "webm", "mov", "avi", "mpg", "mpeg", "wmv", "flv", "ts")
#: Digests under one node of a result's tag.
FAN = 4096
#: Rooms that a snapshot restores; seconds that a room may be idle, and may last.
MOST_ROOMS, IDLE, AGE = 64, 12 * 3600, 48 * 3600


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog documents `<id>/status.json` under a folder.

    Dropped: what is no JSON object, ids that are not twelve hex digits or not their folder's name. An active job
    was interrupted and is queued again; a missing generation is empty.
    """
    raw = spark.read.schema(JOB + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/*/status.json")
    named = raw.withColumn("_dir", F.regexp_extract("_metadata.file_path", r"/([^/]+)/status\.json$", 1))
    good = named.where(r"_corrupt IS NULL AND id RLIKE '^[0-9a-f]{12}\\z' AND id = _dir").drop("_corrupt", "_dir")
    return good.withColumn("state", F.when(F.col("state").isin(*ACTIVE), "queued").otherwise(F.col("state"))).withColumn("generation", F.coalesce("generation", F.lit("")))


def interrupted(catalog: DataFrame) -> DataFrame:
    """Queued jobs, the oldest first, as a restart takes them up."""
    return catalog.where("state = 'queued'").orderBy("created_at", "id")


def by_id(catalog: DataFrame, ident: str) -> DataFrame:
    return catalog.where(F.col("id") == ident)


def rooms(spark: SparkSession, path: str, now: float) -> DataFrame:
    """Rooms of a snapshot of schema 1 (a file, or what `write_rooms` published): of the first MOST_ROOMS those with all that a room needs, not expired.

    They are as after a restart: nothing plays, no player holds them, and clients see a new revision and seek version.
    """
    snapshot = spark.read.schema("schema int, rooms array<string>").option("multiLine", True).json(published(spark, path))
    each = snapshot.where("schema = 1").select(F.posexplode(F.slice("rooms", 1, MOST_ROOMS)).alias("place", "text"))
    whole = each.where(F.size(F.array_except(F.array(*map(F.lit, ROOM_KEYS)), F.json_object_keys("text"))) == 0)
    rooms_ = whole.select(F.from_json("text", ROOM).alias("room")).select("room.*").where("id IS NOT NULL AND queue IS NOT NULL AND playback IS NOT NULL")
    playback = F.col("playback").withField("playing", F.lit(False)).withField("seek_version", F.col("playback.seek_version") + 1)
    open_ = rooms_.where((F.lit(now) - F.col("updated_at") <= IDLE) & (F.lit(now) - F.col("created_at") <= AGE))
    return open_.withColumns({"playback": playback, "revision": F.col("revision") + 1})


def write_rooms(state: DataFrame, path: str, generation: int = 0, expected: int | None = None) -> int:
    """Publish a snapshot (at most MOST_ROOMS rooms) without what lives only in memory; the number of its version."""
    kept = state.drop("lease", "presence").orderBy("created_at", "id").limit(MOST_ROOMS)
    whole = kept.agg(F.collect_list(F.struct(*kept.columns)).alias("rooms")).select(F.lit(1).alias("schema"), "rooms")
    return publish(whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), path, generation, expected, "text")


def operations(spark: SparkSession, path: str) -> DataFrame:
    """Operation log; what was in flight is queued; a corrupt file fails."""
    log = spark.read.schema("id string, job_id string, kind string, state string, created_at double, updated_at double, token string, error string").option("mode", "FAILFAST").json(published(spark, path))
    return log.withColumn("state", F.when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def public_operations(log: DataFrame) -> DataFrame:
    return log.drop("token", "error")


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """Media under a folder by name, without content: path, size, modification time, id in the name. Folders that begin with _ or . are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")
    names = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.expr(f"substring(path, length('{folder.rstrip('/')}') + 2)")
    kept = files.withColumn("path", names).withColumn("rel_path", rel).where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*MEDIA))
    kept = kept.where(~F.col("rel_path").rlike(r"(^|/)[_.][^/]*/"))
    return kept.select("path", "rel_path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.nullif(F.regexp_extract("path", r"\[([A-Za-z0-9_-]{11})\]\.[A-Za-z0-9]+$", 1), F.lit("")).alias("video_id"))


def sidecars(media: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Subtitle files (path) of media: the same folder and stem, then a dot, an optional language, and the format."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    own = media.select(F.col("path").alias("media"), stem.alias("_stem"))
    parts = subtitles.select(
        F.col("path").alias("subtitle"),
        F.regexp_extract("path", r"^(.*?)(?:\.([A-Za-z]{2,3}(?:-[A-Za-z]+)?))?\.(lrc|vtt|srt|ass)$", 1).alias("_stem"),
        F.nullif(F.regexp_extract("path", r"^(.*?)(?:\.([A-Za-z]{2,3}(?:-[A-Za-z]+)?))?\.(lrc|vtt|srt|ass)$", 2), F.lit("")).alias("language"),
        F.regexp_extract("path", r"\.(lrc|vtt|srt|ass)$", 1).alias("format"),
    ).where("format <> ''")
    return own.join(parts, "_stem").drop("_stem")


def chosen_subtitle(subtitles: DataFrame, language: str | None = None) -> DataFrame:
    """The best subtitle of each job: the asked language, then made by people, then Chinese before English, Japanese and Korean."""
    base = F.lower(F.split(F.coalesce("lang", F.lit("")), "-").getItem(0))
    wanted = F.lit((language or "").lower().split("-")[0])
    rank = F.when(base == "zh", 3).when(base.isin("en", "ja", "ko"), 2).otherwise(1)
    order = Window.partitionBy("job_id").orderBy(((wanted != "") & (base == wanted)).desc(), F.coalesce(~F.col("auto"), F.lit(False)).desc(), rank.desc(), "path")
    return subtitles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def public_jobs(catalog: DataFrame) -> DataFrame:
    """Jobs as players see them: without generation, with media (map of addresses), thumbnail and recordings as addresses, and artist
    and track as stored, else as the lyric source names them, else as guessed from the title."""
    at = lambda *parts: F.concat(F.lit("/media/"), "id", F.lit("/"), *parts)
    given = lambda c: F.nullif(c, F.lit(""))
    places = {"instrumental": at(F.lit("stems/"), given(F.col("stems.instrumental"))), "vocals": at(F.lit("stems/"), given(F.col("stems.vocals"))), "lyrics": at(given(F.col("lyrics_file")))}
    media = F.map_filter(F.create_map(*(x for k, v in places.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    # thumbnails of old jobs are paths of the machine that made them
    rel, marker = F.translate("thumbnail", "\\", "/"), F.concat(F.lit("/jobs/"), "id", F.lit("/"))
    inside = F.when(rel.contains(marker), F.substring(rel, F.position(marker, rel) + F.length(marker), F.length(rel))).otherwise(rel)
    local = (F.col("thumbnail") != "") & ~F.col("thumbnail").rlike("^(https?://|/media/)")
    recordings = F.transform(F.filter(F.coalesce("recordings", F.array().cast(catalog.schema["recordings"].dataType)), lambda r: F.coalesce(r["file"], F.lit("")) != ""), lambda r: r.withField("url", at(F.lit("recordings/"), r["file"])))
    named = F.get(F.split("lyrics_source", "·"), F.lit(1))
    named = F.when(F.col("lyrics_source").startswith("LRCLIB") & named.contains(" - ") & given(F.col("track")).isNull(), trimmed(named))
    out = catalog.drop("generation").withColumns({"media": media, "thumbnail": F.when(local, at(F.regexp_replace(inside, "^/+", ""))).otherwise(F.col("thumbnail")), "recordings": recordings, "_named": named})
    rest = F.substring("_named", F.position(F.lit(" - "), F.col("_named")) + 3, F.length("_named"))
    out = out.withColumns({
        "artist": F.when(F.col("_named").isNotNull(), given(trimmed(F.substring_index("_named", " - ", 1)))).otherwise(F.col("artist")),
        "track": F.when(F.col("_named").isNotNull(), given(trimmed(rest))).otherwise(F.col("track")),
        "_none": F.lit(None).cast("string"),
    })
    out = with_guess(out, "title", "_none", "_none")
    unnamed = given(F.col("track")).isNull()
    return out.withColumns({"artist": F.when(unnamed, F.coalesce(given(F.col("artist")), "guessed_artist")).otherwise(F.col("artist")), "track": F.coalesce(given(F.col("track")), "guessed_track")}).drop("_named", "_none", "guessed_artist", "guessed_track")


TRIALS = "guest string, session_end double, job_id string, duration double, at double, expires_at double, completed_at double"


def trials(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The table of guests' trials, one row for each guest; an empty one without a path."""
    return spark.createDataFrame([], TRIALS) if path is None else spark.read.schema(TRIALS).parquet(path)


def write_operations(log: DataFrame, path: str, generation: int = 0, expected: int | None = None) -> int:
    """Publish the operation log as JSON lines, as `operations` reads it; the number of its version. Readers see the old log or the new one."""
    return publish(log, path, generation, expected)


def eligible(catalog: DataFrame, longest: float = 900) -> DataFrame:
    """Songs that a guest may try: finished, a proper id, a known length within limits, an instrumental."""
    return catalog.where(rf"state = 'done' AND id RLIKE '^[0-9a-f]{{12}}\\z' AND duration > 0 AND duration <= {longest} AND NOT isnan(duration) AND coalesce(stems.instrumental, '') <> ''")


def etag(rows: DataFrame, order: list[str]) -> DataFrame:
    """A weak tag of a result in an order: the root of a tree of SHA-256 digests over its rows as text.

    Rows are numbered in order, and each node digests the digests of FAN rows or nodes, so the tag changes with any row and any
    place, doesn't depend on partitions, and no task holds more than FAN digests. Rows that the order doesn't tell apart go by their text.
    """
    text = rows.select(*(F.col(c).alias(f"_{n}") for n, c in enumerate(order)), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("d"))
    level = numbered(text, [*(f"_{n}" for n in range(len(order))), "d"]).select("row", F.sha2("d", 256).alias("d"))
    size = level.count()
    while size > 1:
        nodes = level.groupBy(F.expr(f"(row - 1) div {FAN} + 1").alias("row"))
        level = nodes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "d"))), lambda x: x["d"]), "").alias("d")).withColumn("d", F.sha2("d", 256))
        size = -(-size // FAN)
    root = level.agg(F.coalesce(F.first("d"), F.lit("")).alias("d"))
    return root.select(F.concat(F.lit('W/"'), "d", F.lit('"')).alias("etag"))


def with_recording(catalog: DataFrame, added: DataFrame) -> DataFrame:
    """A recording appended to its job (id, recording)."""
    return catalog.join(added.groupBy("id").agg(F.collect_list("recording").alias("_r")), "id", "left").withColumn("recordings", F.concat(F.coalesce("recordings", F.array().cast(catalog.schema["recordings"].dataType)), F.coalesce("_r", F.array().cast(catalog.schema["recordings"].dataType)))).drop("_r")


def without_recording(catalog: DataFrame, file: str) -> DataFrame:
    return catalog.withColumn("recordings", F.filter("recordings", lambda r: r["file"] != file))
