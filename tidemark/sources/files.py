"""Readers for dumps, comment sets, metric tables and file listings; writers for reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import lexicons, metrics as M, rules as R
from tidemark.operators.accounts import original_sound
from tidemark.operators.joins import replace_rows

AUTHOR = "struct<uid:string,nickname:string,follower_count:bigint,enterprise_verify_reason:string,custom_verify:string,signature:string>"
RAW = (f"struct<aweme_id:string,desc:string,create_time:bigint,author:{AUTHOR},video:struct<duration:bigint,width:bigint,height:bigint>,"
       "music:struct<title:string,author:string>,text_extra:array<struct<hashtag_name:string>>>")
STATISTICS = "struct<digg_count:bigint,comment_count:bigint,share_count:bigint,collect_count:bigint>"
DUMP = f"country string, keyword string, videos array<struct<desc:string,statistics:{STATISTICS},_raw:{RAW}>>"


def read_video_dumps(spark: SparkSession, path: str, name_pattern: str = r"([^/_]+)_([^/]+?)\.json$",
                     multi_line: bool = True) -> DataFrame:
    """Raw videos of a folder of JSON dumps; bad files give no rows and are counted by ``dump_counters``.

    Country and keyword come from the dump, else from the file name.
    """
    return _dumped(spark.read, path, name_pattern, multi_line)


def stream_video_dumps(spark: SparkSession, path: str, name_pattern: str = r"([^/_]+)_([^/]+?)\.json$", multi_line: bool = True,
                       files_per_batch: int | None = None) -> DataFrame:
    """The same rows of a folder that dumps are added to, as a stream. Its query's checkpoint knows the files that were read, so each is read once;
    files must appear whole (moved into the folder) and are not changed later."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return _dumped(reader, path, name_pattern, multi_line)


def _dumped(reader, path: str, name_pattern: str, multi_line: bool) -> DataFrame:
    d = (reader.schema(DUMP + ", _bad string").option("multiLine", multi_line).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path))
    file = F.url_decode(F.col("_metadata.file_path"))
    return d.select(
        file.alias("file"), F.col("_bad").isNotNull().alias("bad"),
        F.coalesce("country", F.nullif(F.regexp_extract(file, name_pattern, 1), F.lit(""))).alias("country"),
        F.coalesce("keyword", F.nullif(F.regexp_extract(file, name_pattern, 2), F.lit(""))).alias("keyword"),
        F.explode_outer("videos").alias("v")).select("file", "bad", "country", "keyword", "v.*")


def video_checks(news: Column) -> dict[str, Column]:
    """First failing check of a raw video, in order."""
    return {"bad_file": F.col("bad"), "no_raw": F.col("_raw").isNull() | F.col("_raw.aweme_id").isNull(), "news": news,
            "no_follower": F.coalesce(F.col("_raw.author.follower_count"), F.lit(0)) <= 0,
            "no_time": F.coalesce(F.col("_raw.create_time"), F.lit(0)) <= 0}


def video_features(videos: DataFrame, zone: str = "Asia/Shanghai", hooks: R.Rules = tuple(lexicons.TITLE_HOOKS),
                   tiers: tuple[Sequence[tuple[float, str]], str] = M.FOLLOWER_TIERS) -> DataFrame:
    """Flat feature rows of valid raw videos: counts, ratios, follower ``tiers`` (bounds, label above), times, title hooks and flags, sound flag."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ts = F.from_utc_timestamp(F.timestamp_seconds("_raw.create_time"), zone)
    w, h = F.col("_raw.video.width"), F.col("_raw.video.height")
    flat = videos.select(
        F.col("_raw.aweme_id").alias("aweme_id"), "country", "keyword", F.coalesce("_raw.desc", "desc").alias("desc"),
        n("statistics.digg_count").alias("likes"), n("statistics.comment_count").alias("comments"),
        n("statistics.share_count").alias("shares"), n("statistics.collect_count").alias("collects"),
        F.col("_raw.author.uid").alias("author_uid"), F.col("_raw.author.nickname").alias("nickname"),
        F.col("_raw.author.follower_count").alias("follower_count"), (F.col("_raw.video.duration") / 1000.0).alias("duration_sec"),
        F.when((w > 0) & (h > 0), h > w).alias("is_portrait"),
        F.coalesce(F.array_compact(F.transform("_raw.text_extra", lambda x: x["hashtag_name"])), F.array().cast("array<string>")).alias("tags"),
        ts.alias("published"), F.col("_raw.music.title").alias("music_title"), F.col("_raw.music.author").alias("music_author"))
    flat = flat.withColumns({
        "hooks": R.all_labels(F.coalesce("desc", F.lit("")), hooks), "tag_count": F.size("tags"),
        "is_original_sound": original_sound(F.col("music_title"), F.col("music_author"), F.col("nickname")),
        **{name: R.matches(F.coalesce("desc", F.lit("")), p) for name, p in (
            ("has_question", lexicons.QUESTION_MARKS), ("has_number", lexicons.NUMBER_MARKS), ("has_exclamation", lexicons.EXCLAMATION_MARKS))},
    }).drop("music_title", "music_author")
    flat = M.engagement_ratios(flat, "likes", "comments", "shares", "collects", "follower_count")
    return flat.withColumns({
        "follower_tier": R.bucket_label(F.col("follower_count"), *tiers), "period": M.period_label(F.col("published")),
        "day_of_week": F.date_format("published", "EEEE"), "hour": F.hour("published"), "char_count": F.length("desc")})


def read_comment_sets(spark: SparkSession, path: str, name_pattern: str = r"/(?:account_|keyword_)([^/]+)/", whole_file: bool = True) -> DataFrame:
    """Comment arrays of one folder per dataset: dataset, pos, text."""
    raw = spark.read.option("wholetext", whole_file).option("recursiveFileLookup", True).text(path)
    file = F.url_decode(F.col("_metadata.file_path"))
    texts = F.from_json("value", T.ArrayType(T.StringType()))
    return raw.select(F.regexp_extract(file, name_pattern, 1).alias("dataset"), F.posexplode(texts).alias("pos", "text"))


#: fixed values: headers of the metric export
METRIC_HEADERS = {
    "_id": "note_id", "标题": "title", "发布时间": "post_time", "曝光": "imp", "观看": "read_cnt", "封面点击率": "cover_ctr", "点赞": "like_cnt",
    "评论": "comment_cnt", "收藏": "fav_cnt", "涨粉": "fans_delta", "分享": "share_cnt", "人均观看时长": "view_time_avg", "弹幕": "danmaku",
}


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def ingest_metrics(raw: DataFrame, day: Column, stored: DataFrame | None = None, headers: Mapping[str, str] = METRIC_HEADERS,
                   digest: str = "sha1", order: Sequence[str] = ()) -> DataFrame:
    """Localized metric rows to typed snapshot rows; the same (date, note) replaces the stored one.

    Of rows with one key the last by the columns ``order`` stays, then by content, so arrival decides nothing.
    """
    d = raw.withColumnsRenamed({k: v for k, v in headers.items() if k in raw.columns})
    for c in headers.values():
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    numbers = [c for c in headers.values() if c not in ("note_id", "title", "post_time", "cover_ctr", "view_time_avg")]
    rows = d.where(text("title").isNotNull() | text("note_id").isNotNull()).select(
        day.alias("snapshot_date"), M.note_key(F.col("note_id"), F.col("title"), F.col("post_time"), digest).alias("note_key"),
        text("note_id").alias("note_id"), text("title").alias("title"), text("post_time").alias("post_time"),
        M.parse_rate(F.col("cover_ctr")).alias("cover_ctr"), text("view_time_avg").alias("view_time_avg"),
        *[M.parse_int(F.col(c)).alias(c) for c in numbers], F.struct(*[F.col(c).cast("double").alias(f"o{i}") for i, c in enumerate(order)], F.lit(0).alias("none")).alias("_order"))
    columns = [c for c in rows.columns if c not in ("snapshot_date", "note_key", "_order")]
    rows = rows.groupBy("snapshot_date", "note_key").agg(F.max(F.struct("_order", *columns)).alias("r")).select("snapshot_date", "note_key", *[f"r.{c}" for c in columns])
    return rows if stored is None else replace_rows(stored, rows, ["snapshot_date", "note_key"])


NOTE_INFO = ("array<struct<id:string,title:string,post_time:bigint,imp_count:bigint,read_count:bigint,coverClickRate:double,like_count:bigint,"
             "comment_count:bigint,fav_count:bigint,increase_fans_count:bigint,share_count:bigint,view_time_avg:double,danmaku_count:bigint>>")


def normalize_metric_payload(df: DataFrame, col: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """Note metrics of a creator-centre answer; unknown values stay NULL, rates in 0..1 become percent."""
    n = df.select(F.explode(F.from_json(F.get_json_object(col, "$.note_infos"), T._parse_datatype_string(NOTE_INFO))).alias("n")).select("n.*")
    rate = F.col("coverClickRate")
    return n.select(
        F.col("id").alias("note_id"), "title",
        F.date_format(F.from_utc_timestamp(F.timestamp_millis("post_time"), zone), "yyyy-MM-dd HH:mm").alias("post_time"),
        F.col("imp_count").alias("imp"), F.col("read_count").alias("read_cnt"),
        F.when(rate.between(0, 1), rate * 100).otherwise(rate).alias("cover_ctr_pct"), F.col("like_count").alias("like_cnt"),
        F.col("comment_count").alias("comment_cnt"), F.col("fav_count").alias("fav_cnt"), F.col("increase_fans_count").alias("fans_delta"),
        F.col("share_count").alias("share_cnt"), F.floor("view_time_avg").alias("view_seconds"), F.col("danmaku_count").alias("danmaku"))


def source_scan(spark: SparkSession, root: str, extensions: Sequence[str], rules: Sequence[tuple[str, str, str]],
                default: tuple[str, str] = ("未分类素材", "MISC")) -> DataFrame:
    """Files below a root with their size, time and category; file contents are not read.

    ``rules``: (path pattern, type, code), first match wins.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root).select("path", "modificationTime", "length"))
    p = F.url_decode("path")
    return files.select(F.col("path"), "length", "modificationTime",
                        R.first_label(p, [(t, x) for x, t, _ in rules], default[0]).alias("source_type"),
                        R.first_label(p, [(c, x) for x, _, c in rules], default[1]).alias("code"))


def export_tables(sheets: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """Each report sheet as one named table; returns the folder of each."""
    out = {}
    for name, df in sheets.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        w = df.write.mode(mode).format(fmt)
        (w.option("header", True) if fmt == "csv" else w).save(out[name])
    return out


def markdown_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows of a Markdown table, for a text sink."""
    cols = list(cols or df.columns)
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"[|\n]", " ") for c in cols]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
