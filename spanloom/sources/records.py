"""Records from outside as rows: feeds in XML, scraped JSON with fallbacks, and what a user typed as a source.

Parsing is Spark's own: ``from_xml`` and ``from_json`` with fixed schemas in permissive mode, so a broken record gives nulls and never fails a job; the rules
behind them are column expressions. Every function takes a column of texts and keeps the row's key.

Defined results: null, empty and broken texts give no feed entries, a record of nulls, or a reason instead of a kind; entries without an
id are dropped; numbers that are not all digits are null; keys that are there but null or empty count as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.registry import query, table

# ---- feeds ----------------------------------------------------------------------------------------
FEED = "entry array<struct<videoId:string,title:string,published:string,group:struct<thumbnail:array<struct<_url:string>>,description:string,community:struct<statistics:struct<_views:string>>>>>"


def feed_entries(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, place, id, title, published, thumbnail, description, views) of each entry with an id; namespaces do not matter."""
    parsed = F.from_xml(F.col(xml), FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    rows = feeds.where(F.col(xml).isNotNull()).select(key, F.posexplode(parsed["entry"]).alias("place", "e")).where("trim(e.videoId) <> ''")
    views = F.col("e.group.community.statistics._views")
    return rows.select(
        key, "place", F.col("e.videoId").alias("id"), F.coalesce("e.title", F.lit("")).alias("title"), F.try_to_timestamp("e.published").alias("published"), F.get("e.group.thumbnail", F.lit(0))["_url"].alias("thumbnail"),
        F.col("e.group.description").alias("description"), F.when(views.rlike("^[0-9]+$"), views.cast("bigint")).alias("views"),
    )


# ---- records --------------------------------------------------------------------------------------
RECORD = (
    "id string, title string, fulltitle string, timestamp string, release_timestamp string, upload_date string, release_date string, duration double, view_count bigint, thumbnail string,"
    " thumbnails array<struct<id:string,url:string,width:bigint,height:bigint>>, channel_id string, uploader_id string"
)


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor an empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def record_time(r: Column) -> Column:
    """A time of epoch seconds under either key, else a day written as eight digits, else null."""
    epochs = [F.when(r[c].rlike("^-?[0-9]+$") & (r[c] != "0"), F.timestamp_seconds(r[c].cast("bigint"))) for c in ("timestamp", "release_timestamp")]
    day = first_present(r["upload_date"], r["release_date"])
    return F.coalesce(*epochs, F.when(day.rlike("^[0-9]{8}$"), F.try_to_timestamp(day, F.lit("yyyyMMdd"))))


def best_thumbnail(r: Column) -> Column:
    """The picture with the largest area, the last of equal ones, portraits and banners aside; else the record's single one."""
    shown = F.filter(F.coalesce(r["thumbnails"], F.array().cast("array<struct<id:string,url:string,width:bigint,height:bigint>>")), lambda t: ~F.coalesce(t["id"], F.lit("")).rlike("avatar|banner"))
    sized = F.transform(shown, lambda t, i: F.struct((F.coalesce(t["width"], F.lit(0)) * F.coalesce(t["height"], F.lit(0))).alias("area"), i.alias("i"), t["url"].alias("url")))
    return first_present(F.array_max(sized)["url"], r["thumbnail"])


def normalised_records(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, id, title, published, duration, views, thumbnail, channel) of scraped JSON records, each field by its chain of fallbacks."""
    r = F.col("_record")
    parsed = rows.select(key, F.from_json(json, RECORD).alias("_record"))
    return parsed.select(
        key, first_present(r["id"]).alias("id"), first_present(r["title"], r["fulltitle"], F.lit("Untitled")).alias("title"), record_time(r).alias("published"), r["duration"].alias("duration"),
        r["view_count"].alias("views"), first_present(r["thumbnail"], best_thumbnail(r)).alias("thumbnail"), best_thumbnail(r).alias("largest"), first_present(r["channel_id"], r["uploader_id"]).alias("channel"),
    )


# ---- sources as typed -----------------------------------------------------------------------------
#: Hosts, forms of identifiers, tabs, reserved first parts and file types.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be", "youtube-nocookie.com", "www.youtube-nocookie.com")
VIDEO, CHANNEL, PLAYLIST, HANDLE = "^[A-Za-z0-9_-]{11}$", "^UC[A-Za-z0-9_-]{22}$", "^(PL|UU|LL|FL|OL|RD|UL|PU)[A-Za-z0-9_-]{10,}$", r"^@?([\p{L}\p{N}_.\-·]{3,30})$"
TABS = ("videos", "shorts", "streams", "featured", "playlists", "community", "about", "live", "podcasts", "releases", "search")
RESERVED = ("results", "feed", "account", "premium", "gaming", "hashtag", "redirect")
FILES = r"(?i)\.(mp4|mkv|mov|webm|avi|m4v|wmv|flv|ts|mts|m2ts)$"


def seconds_of(text: Column) -> Column:
    """Seconds of ``90``, ``90s`` or ``1h2m3s``; null for other texts."""
    t = F.regexp_replace(F.trim(text), "s+$", "")
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, "^(?:([0-9]+)h)?(?:([0-9]+)m)?(?:([0-9]+))?$", k), F.lit("")).cast("double"), F.lit(0.0))
    return F.when((t != "") & t.rlike("^(?:[0-9]+h)?(?:[0-9]+m)?(?:[0-9]+)?$"), part(1) * 3600 + part(2) * 60 + part(3))


def source_reference(text: Column) -> Column:
    """struct<kind, value, list, start, reason>: a file, handle, channel, playlist or video, or the reason why it is none."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), '^"+|"+$', ""), "^'+|'+$", ""))
    made = lambda kind, value, listed=None, start=None: F.struct(F.lit(kind).alias("kind"), value.alias("value"), (listed if listed is not None else F.lit(None).cast("string")).alias("list"), (start if start is not None else F.lit(None).cast("double")).alias("start"), F.lit(None).cast("string").alias("reason"))
    no = lambda why: F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("list"), F.lit(None).cast("double").alias("start"), F.lit(why).alias("reason"))

    def of(raw: Column) -> Column:
        path_like = raw.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|/|\./|\.\./|\.\\|\.\.\\|~)") | (raw.rlike(FILES) & ~F.contains(raw, F.lit("://")))
        url = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
        host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
        parts = F.filter(F.split(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
        asked = F.regexp_extract(url, r"\?([^#]*)", 1)
        value = lambda name: F.nullif(F.regexp_extract(asked, f"(?:^|&){name}=([^&]*)", 1), F.lit(""))
        head, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        listed, start, vid = value("list"), seconds_of(F.coalesce(value("t"), value("start"))), value("v")
        handle = lambda t: F.concat(F.lit("@"), F.regexp_extract(t, HANDLE, 1))
        vanity = (F.size(parts) <= 2) & ((F.size(parts) == 1) | second.isin(*TABS)) & head.rlike(r"^[\p{L}\p{N}_.\-]{2,100}$") & ~head.isin(*RESERVED)
        return (
            F.when(raw == "", no("nothing entered"))
            .when(path_like, F.when(raw.rlike(FILES), made("local_file", raw)).otherwise(no("no video file")))
            .when(raw.startswith("@"), F.when(raw.rlike(HANDLE), made("handle", handle(raw))).otherwise(no("no valid handle")))
            .when(raw.rlike(CHANNEL), made("channel", raw)).when(raw.rlike(PLAYLIST) & ~raw.rlike(VIDEO), made("playlist", raw))
            .when(~host.isin(*HOSTS), no("unknown host"))
            .when(host.endswith("youtu.be"), F.when(head.rlike(VIDEO), made("video", head, listed, start)).otherwise(no("short link without a video")))
            .when(F.size(parts) == 0, no("no target"))
            .when(head == "watch", F.when(vid.rlike(VIDEO), made("video", vid, listed, start)).when(listed.isNotNull(), made("playlist", listed)).otherwise(no("no video id")))
            .when(head.isin("shorts", "live", "embed", "v", "e") & second.rlike(VIDEO), made("video", second, listed, start))
            .when(head == "playlist", F.when(listed.isNotNull(), made("playlist", listed)).otherwise(no("no list")))
            .when(head.startswith("@"), F.when(head.rlike(HANDLE), made("handle", handle(head))).otherwise(no("no valid handle")))
            .when((head == "channel") & second.rlike(CHANNEL), made("channel", second))
            .when(head.isin("c", "user") & second.isNotNull(), made("channel", F.concat_ws("/", head, second)))
            .when(vanity, made("channel", head)).otherwise(no("no target"))
        )

    return F.element_at(F.transform(F.array(raw), of), 1)


def canonical_url(ref: Column) -> Column:
    """The address of a reference; a file is its own."""
    base, v = F.lit("https://www.youtube.com/"), ref["value"]
    plain = F.concat(base, F.when(v.rlike(CHANNEL), F.lit("channel/")).otherwise(""), v)
    return F.when(ref["kind"] == "video", F.concat(base, F.lit("watch?v="), v)).when(ref["kind"] == "playlist", F.concat(base, F.lit("playlist?list="), v)).when(ref["kind"].isin("channel", "handle"), plain).otherwise(v)


def uploads_list(channel: Column) -> Column:
    """The list of all uploads of a channel id; null for other texts."""
    return F.when(channel.rlike(CHANNEL), F.concat(F.lit("UU"), F.substring(channel, 3, 100)))


# ---- registered queries -----------------------------------------------------------------------------
def feeds_of(events: DataFrame) -> DataFrame:
    """Each user's events as an XML feed: some entries have no id, no group, or views that are no number."""
    e = F.col("event_id")
    group = F.concat(
        F.lit('<media:group><media:thumbnail url="t/'), e, F.lit('.jpg"/><media:description>d &lt;'), F.col("event_type"), F.lit('&gt;</media:description><media:community><media:statistics views="'),
        F.when(e % 5 == 0, "n/a").otherwise(F.floor(F.col("value") * 10).cast("string")), F.lit('"/></media:community></media:group>'),
    )
    entry = F.concat(
        F.lit("<entry><yt:videoId>"), F.when(e % 7 == 0, "").otherwise(F.concat(F.lit("v"), e)), F.lit("</yt:videoId><title>a &amp; b "), e, F.lit("</title><published>"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("+00:00</published>"), F.when(e % 11 == 0, "").otherwise(group), F.lit("</entry>"),
    )
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="urn:yt" xmlns:media="urn:media"><title>feed</title>'
    return events.groupBy("user_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("x")))), lambda s: s["x"]), ""), F.lit("</feed>")).alias("xml"))


@query(
    "feed_entries",
    """SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS place, 'v' || event_id AS id, 'a & b ' || event_id AS title, date_trunc('second', ts)::TIMESTAMP AS published, CASE WHEN event_id % 11 <> 0 THEN 't/' || event_id || '.jpg' END AS thumbnail,
    CASE WHEN event_id % 11 <> 0 THEN 'd <' || event_type || '>' END AS description, CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 0 THEN floor(value * 10)::BIGINT END AS views FROM events QUALIFY event_id % 7 <> 0""",
)
def feed_entries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed_entries(feeds_of(table(spark, sf_dir, "events")), "user_id", "xml")
    return rows.withColumn("published", F.col("published").cast("timestamp_ntz"))


@query(
    "normalised_records",
    """SELECT event_id, 'v' || event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'Untitled' WHEN event_id % 4 = 1 THEN 'full ' || event_type ELSE event_type END AS title, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN date_trunc('day', ts) END::TIMESTAMP AS published, value AS duration,
    CASE WHEN event_id % 6 <> 0 THEN floor(value)::BIGINT END AS views, CASE event_id % 5 WHEN 0 THEN 'own.jpg' WHEN 1 THEN 'c.jpg' WHEN 2 THEN 'b.jpg' END AS thumbnail, CASE event_id % 5 WHEN 0 THEN 'own.jpg' WHEN 1 THEN 'c.jpg' WHEN 2 THEN 'b.jpg' END AS largest, 'user' || user_id AS channel FROM events""",
)
def normalised_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a scraped record with missing, empty and second-choice fields."""
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    picture = lambda name, url, w, h: F.struct(F.lit(name).alias("id"), F.lit(url).alias("url"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    many = F.array(picture("0", "a.jpg", 10, 10), picture("1", "b.jpg", 20, 20), picture("2", "c.jpg", 40, 10), picture("avatar_uncropped", "x.jpg", 900, 900))
    few = F.array(picture("0", "b.jpg", 5, 5), picture("banner", "x.jpg", 900, 900))
    record = F.struct(
        F.concat(F.lit("v"), e).alias("id"), F.when(e % 4 >= 2, F.col("event_type")).when(e % 4 == 0, "").alias("title"), F.when(e % 4 == 1, F.concat(F.lit("full "), F.col("event_type"))).alias("fulltitle"),
        F.when(e % 3 == 0, F.unix_seconds(ts)).when(e % 3 == 1, 0).alias("timestamp"), F.when(e % 3 == 1, F.date_format(ts, "yyyyMMdd")).when(e % 3 == 2, "soon").alias("upload_date"), F.col("value").alias("duration"),
        F.when(e % 6 != 0, F.floor("value")).alias("view_count"), F.when(e % 5 == 0, "own.jpg").alias("thumbnail"), F.when(e % 5 == 1, many).when(e % 5 == 2, few).alias("thumbnails"), F.concat(F.lit("user"), F.col("user_id")).alias("uploader_id"),
    )
    rows = normalised_records(table(spark, sf_dir, "events").select("event_id", F.to_json(record).alias("json")), "event_id", "json")
    return rows.withColumn("published", F.col("published").cast("timestamp_ntz"))


#: What users typed, by page number: (text with {v} a video id, {c} a channel's last 22 signs, {p} a page's address; kind, value, list, start, reason).
TYPED: Sequence[tuple] = (
    (" '@some.one' ", "handle", "@some.one", None, None, None), ("@x", None, None, None, None, "no valid handle"), ("UC{c}", "channel", "UC{c}", None, None, None), ("PL{c}", "playlist", "PL{c}", None, None, None),
    ("https://www.youtube.com/watch?v={v}&list=PLabc&t=1m30s", "video", "{v}", "PLabc", 90.0, None), ("youtu.be/{v}?start=45", "video", "{v}", None, 45.0, None), ("youtu.be/short", None, None, None, None, "short link without a video"),
    ("m.youtube.com/shorts/{v}", "video", "{v}", None, None, None), ("https://youtube.com/watch?list=PLx", "playlist", "PLx", None, None, None), ("https://youtube.com/watch?v=bad", None, None, None, None, "no video id"),
    ("youtube.com/@name/videos", "handle", "@name", None, None, None), ("youtube.com/channel/UC{c}", "channel", "UC{c}", None, None, None), ("youtube.com/user/abc", "channel", "user/abc", None, None, None), ("youtube.com/SomeName/videos", "channel", "SomeName", None, None, None),
    ("youtube.com/results", None, None, None, None, "no target"), ("https://youtube.com/", None, None, None, None, "no target"), ("C:\\films\\a.MP4", "local_file", "C:\\films\\a.MP4", None, None, None), ("./notes.txt", None, None, None, None, "no video file"),
    ("clip.webm", "local_file", "clip.webm", None, None, None), ("", None, None, None, None, "nothing entered"), ("{p}", None, None, None, None, "unknown host"), ("youtube.com/playlist", None, None, None, None, "no list"), ("HTTPS://WWW.YouTube.com/embed/{v}?t=2h", "video", "{v}", None, 7200.0, None),
)


def _typed_sql(k: int) -> str:
    def text(value: str | float | None) -> str:
        if value is None or isinstance(value, float):
            return "NULL" if value is None else f"{value}::DOUBLE"
        return "replace(replace('" + value.replace("'", "''") + "', '{v}', vid), '{c}', cid)"

    return "CASE page_id % " + str(len(TYPED)) + " " + " ".join(f"WHEN {i} THEN {text(t[k])}" for i, t in enumerate(TYPED)) + " END"


@query("source_references", f"SELECT page_id, {_typed_sql(1)} AS kind, {_typed_sql(2)} AS value, {_typed_sql(3)} AS list, {_typed_sql(4)} AS start, {_typed_sql(5)} AS reason FROM (SELECT page_id, lpad('v' || page_id, 11, '_') AS vid, lpad('c' || page_id, 22, '-') AS cid FROM pages)")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users might type for each page, as references."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.lpad(F.concat(F.lit("v"), "page_id"), 11, "_").alias("vid"), F.lpad(F.concat(F.lit("c"), "page_id"), 22, "-").alias("cid"))
    form = F.element_at(F.array(*[F.lit(t[0]) for t in TYPED]), (F.col("page_id") % len(TYPED) + 1).cast("int"))
    typed = F.replace(F.replace(F.replace(form, F.lit("{v}"), F.col("vid")), F.lit("{c}"), F.col("cid")), F.lit("{p}"), F.col("url"))
    ref = source_reference(typed)
    return rows.select("page_id", ref.alias("r")).select("page_id", "r.kind", "r.value", "r.list", "r.start", "r.reason")
