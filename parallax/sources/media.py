"""Media listings, probe records, names and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes read, and stems that mark the program's own output.
PHOTOS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "heic", "heif")
VIDEOS = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mts", "m2ts", "wmv", "flv")
OWN_TAGS = ("_sbs", "_sbs_cross", "_hsbs", "_hsbs_cross", "_depth")

PROBE = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,"
    "r_frame_rate:string,nb_frames:string,duration:string,tags:struct<rotate:string>,"
    "side_data_list:array<struct<rotation:double>>>>,format:struct<duration:string>>"
)


def list_media(spark: SparkSession, *inputs: str) -> DataFrame:
    """Files of folders (one level, photos and videos only), single files (whatever their suffix) and globs, without own output.

    Paths, sizes and times come from the listing; contents are not read unless they are selected.
    """
    jvm = spark._jvm
    out = None
    for item in inputs:
        path = jvm.org.apache.hadoop.fs.Path(item)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        folder = store.exists(path) and store.getFileStatus(path).isDirectory()
        if not folder and not store.globStatus(path):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(item)
        files = files.where(is_media(F.col("path"))) if folder else files
        out = files if out is None else out.unionByName(files)
    if out is None:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return out.where(~is_own(F.col("path"))).orderBy("path")


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, content) whose SHA-256 is the one expected (path, sha256). Either table may be large: Spark chooses the join."""
    return files.join(expected, "path").where(F.sha2("content", 256) == F.lower("sha256")).select(files.columns)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def is_media(path: Column) -> Column:
    return suffix(path).isin(*PHOTOS, *VIDEOS)


def is_own(path: Column) -> Column:
    return stem(path).rlike("(" + "|".join(OWN_TAGS) + ")$")


def upright(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Size after the stored orientation: 5 to 8 lie on their side."""
    turned = orientation.isin(5, 6, 7, 8)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def rate(text: Column) -> Column:
    """"a/b", "a" or "a/" as a positive number, else null."""
    parts = F.split(text, "/", 2)
    top = F.element_at(parts, 1).try_cast("double")
    under = F.when(F.size(parts) < 2, F.lit(1.0)).when(F.element_at(parts, 2) == "", 1.0).otherwise(F.try_element_at(parts, F.lit(2)).try_cast("double"))
    value = F.try_divide(top, under)
    return F.when(value > 0, value)


def probe(text: Column) -> dict[str, Column]:
    """Clip record of a prober's JSON: first video stream, upright size, rate, frames and first audio codec."""
    info = F.from_json(text, PROBE)
    of = lambda kind: F.try_element_at(F.filter(info["streams"], lambda s: s["codec_type"] == kind), F.lit(1))
    video = of("video")
    side = F.try_element_at(F.filter(video["side_data_list"], lambda s: s["rotation"].isNotNull()), F.lit(1))["rotation"]
    rotation = F.coalesce(F.bround(video["tags"]["rotate"].try_cast("double"), 0), F.bround(side, 0), F.lit(0.0))
    turned = F.pmod(rotation, F.lit(180.0)) == 90.0
    fps = F.coalesce(rate(video["avg_frame_rate"]), rate(video["r_frame_rate"]), F.lit(30.0))
    number = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    duration = F.coalesce(number(info["format"]["duration"]), number(video["duration"]), F.lit(0.0))
    frames = F.coalesce(F.nullif(video["nb_frames"].try_cast("long"), F.lit(0)), F.bround(duration * fps, 0).cast("long"))
    return {
        "width": F.when(turned, video["height"]).otherwise(video["width"]),
        "height": F.when(turned, video["width"]).otherwise(video["height"]),
        "rotation": rotation,
        "fps": fps,
        "duration": duration,
        "frames": frames,
        "audio": of("audio")["codec_name"],
    }


def tag(sphere: Column, full: Column, crossed: Column) -> Column:
    return F.concat(
        F.lit("_"),
        F.concat_ws(
            "_",
            F.when(sphere, "180x180"),
            F.when(sphere | full, "full_sbs").otherwise("hsbs"),
            F.when(crossed, "cross"),
        ),
    )


def folder_of(path: Column) -> Column:
    """What stands before the name, with its slash; nothing for a bare name."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def _output(path: Column, name: Column, ext: Column, dst: Column) -> Column:
    """Beside the source, or in ``dst`` if that has no suffix, or ``dst`` itself."""
    file = F.concat(stem(path), name, F.lit("."), ext)
    inside = F.concat(F.regexp_replace(dst, "/+$", ""), F.lit("/"), file)
    return F.when(dst.isNull(), F.concat(folder_of(path), file)).when(suffix(dst) == "", inside).otherwise(dst)


def photo_path(path: Column, name: Column, dst: Column, fmt: Column) -> Column:
    """Output of a photo: its stem, the tag, and the format asked for, by default its own, if that can be written, else .jpg."""
    asked = F.when(fmt == "auto", suffix(path)).otherwise(fmt)
    return _output(path, name, F.when(asked.isin("jpg", "jpeg", "png"), asked).otherwise("jpg"), dst)


def video_path(path: Column, name: Column, dst: Column) -> Column:
    return _output(path, name, F.lit("mp4"), dst)


def photo_name(path: Column, name: Column) -> Column:
    """File name alone of a photo's output."""
    return F.regexp_extract(photo_path(path, name, F.lit(None).cast("string"), F.lit("auto")), r"([^/]*)$", 1)


def log_fields(line: Column) -> Column:
    """Map of the key=value fields of a log line, the last of repeated keys. Values that hold spaces are quoted."""
    pattern = F.lit(r"(\w+)=('[^']*'|\"[^\"]*\"|\S+)")
    keys, values = (F.regexp_extract_all(line, pattern, F.lit(k)) for k in (1, 2))
    fields = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, i + 2, F.size(fields)), lambda g: g["k"] == f["k"]))
    return F.map_from_entries(last)


def log_event(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^(.*?)(?:\s+\w+=|$)", 1))


def sphere_description(patch: dict[str, Column], width: Column, height: Column, heading: Column) -> Column:
    """The panorama description of one eye's picture, as photo metadata. Names and frame of the format."""
    field = lambda n, v: F.concat(F.lit(f'GPano:{n}="'), v.cast("string"), F.lit('" '))
    return F.concat(
        F.lit('<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/">'),
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" '),
        F.lit('xmlns:GPano="http://ns.google.com/photos/1.0/panorama/" GPano:UsePanoramaViewer="False" GPano:ProjectionType="equirectangular" '),
        field("CroppedAreaImageWidthPixels", width), field("CroppedAreaImageHeightPixels", height),
        field("FullPanoWidthPixels", patch["full_width"]), field("FullPanoHeightPixels", patch["full_height"]),
        field("CroppedAreaLeftPixels", patch["left"]), field("CroppedAreaTopPixels", patch["top"]),
        field("InitialViewHeadingDegrees", F.bround(heading, 0).cast("long")),
        F.lit('GPano:InitialViewPitchDegrees="0" GPano:InitialViewRollDegrees="0"/></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'),
    )


def shifted(offsets: Column, at: Column, by: Column) -> Column:
    """Chunk offsets after ``by`` bytes went in at ``at``."""
    return F.transform(offsets, lambda o: F.when(o >= at, o + by).otherwise(o))
