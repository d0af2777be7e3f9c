"""Scalar functions: text, paths, dates, numbers, boxes. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the two media types.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif", "heic", "avif")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "flv", "wmv")


# --- text


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def contains_ignoring_case(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def equals_ignoring_ascii_case(a: Column, b: Column) -> Column:
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(a) == fold(b)


def without_colours(line: Column) -> Column:
    """Console colour codes are taken out."""
    return F.regexp_replace(line, "\u001b\\[[0-9;]*m", "")


# --- paths


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case, without the dot; empty if there is none (a leading dot starts a name, not an extension)."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def join_path(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), name)


def resolved(path: Column, base: Column) -> Column:
    """An absolute path stays; a relative one is under base."""
    return F.when(path.startswith("/"), path).otherwise(join_path(base, path))


def media_type(path: Column) -> Column:
    """image, video, or null, by extension."""
    e = extension(path)
    return F.when(e.isin(*IMAGE_EXTENSIONS), F.lit("image")).when(e.isin(*VIDEO_EXTENSIONS), F.lit("video"))


def uploadable(mime: Column, path: Column) -> Column:
    """An image or video MIME type, or a known extension."""
    return F.coalesce(mime.rlike("^(image|video)/"), F.lit(False)) | F.coalesce(media_type(path).isNotNull(), F.lit(False))


# --- dates

_DAY = r"\d{4}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01])"


def year_month(text: Column) -> Column:
    """struct<y, m> from a date text, or null.

    Strict forms (RFC 3339, with T or blank and a time, or a date alone) take any year, and read year and month in the text's own
    offset. Other texts of seven characters or more count by their first two fields, cut at '-' or '/', for the years 1900
    to 2100.
    """
    strict = text.rlike(rf"^{_DAY}(?:T\d{{1,2}}:\d{{1,2}}:\d{{1,2}}(?:\.\d+)?(?:Z|z|[+-]\d{{2}}:\d{{2}})?| \d{{1,2}}:\d{{1,2}}:\d{{1,2}})?$") & F.try_to_date(F.substring_index(F.substring_index(text, "T", 1), " ", 1), "y-M-d").isNotNull()
    y = F.regexp_extract(text, r"^\+?(\d{1,9})[-/]\+?(\d{1,9})(?:[-/]|$)", 1).try_cast("int")
    m = F.regexp_extract(text, r"^\+?(\d{1,9})[-/]\+?(\d{1,9})(?:[-/]|$)", 2).try_cast("int")
    loose = (F.length(text) >= 7) & y.between(1900, 2100) & m.between(1, 12)
    return F.when(strict | loose, F.struct(y.alias("y"), m.alias("m")))


def year_month_of(created: Column, modified: Column) -> Column:
    """The first that can be read of created and modified, else January 1970."""
    return F.coalesce(year_month(created), year_month(modified), F.struct(F.lit(1970).alias("y"), F.lit(1).alias("m")))


def month_label(y: Column, m: Column) -> Column:
    return F.concat(F.lit("Tháng "), m.cast("string"), F.lit(" "), y.cast("string"))


def utc_text(ts: Column) -> Column:
    """Second resolution, UTC."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd HH:mm:ss")


def rfc3339(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ssxxx")


def day_key(y: Column, m: Column, d: Column) -> Column:
    """Not padded, so that it sorts as text the way the library always has."""
    return F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string"))


# --- numbers


def fraction(text: Column) -> Column:
    """'a/b' as a number; null for b = 0 or what isn't a fraction or a number."""
    parts = F.split(text, "/")
    value = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    return F.when(F.size(parts) == 2, value).otherwise(text.try_cast("double"))


def pts_time(line: Column) -> Column:
    return F.regexp_extract(line, r"pts_time:([0-9.]+)", 1).try_cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -88.0, 88.0)))


def softmax2(a: Column, b: Column) -> Column:
    """Share of b in exp(a) + exp(b), safe against overflow and division by nothing."""
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top) + F.lit(1e-6))


def face_score(cls: Column, obj: Column) -> Column:
    return F.sqrt(clamp(cls, 0.0, 1.0) * clamp(obj, 0.0, 1.0))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma, by thousandths."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def good_brightness(mean_luma: Column) -> Column:
    """A frame that can't be read (null) passes, as if at 128."""
    return F.coalesce(mean_luma, F.lit(128.0)).between(25, 240)


def letterbox(w: Column, h: Column, size: int = 640) -> Column:
    """struct<ratio, pad_x, pad_y> that fits an image into a square."""
    ratio = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    return F.struct(ratio.alias("ratio"), ((size - F.round(w * ratio)) / 2).alias("pad_x"), ((size - F.round(h * ratio)) / 2).alias("pad_y"))


def unpadded(v: Column, pad: Column, ratio: Column, limit: Column) -> Column:
    return F.least(F.greatest((v - pad) / ratio, F.lit(0.0)), limit)


# --- boxes


def corners_to_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def iou_corners(a: Column, b: Column) -> Column:
    """Overlap of struct<x1,y1,x2,y2> boxes; a box whose corners are the wrong way round has no area; 0 where the union has none."""
    side = lambda low, high: F.greatest(high - low, F.lit(0.0))
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: side(r["x1"], r["x2"]) * side(r["y1"], r["y2"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def iou_boxes(a: Column, b: Column) -> Column:
    """Overlap of struct<x,y,w,h> boxes."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    return F.try_divide(w * h, a["w"] * a["h"] + b["w"] * b["h"] - w * h)


def inside(px: Column, py: Column, box: Column) -> Column:
    """A point in a box, all sides included."""
    return px.between(box["x"], box["x"] + box["w"]) & py.between(box["y"], box["y"] + box["h"])


# --- frames, days, results


def frame_seconds(frame: Column, fps: Column) -> Column:
    """When a frame is shown."""
    return frame.cast("double") / fps


# The names of weekdays in the long date label, Sunday first.
WEEKDAYS = ("Chủ Nhật", "Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy")


def long_date(at: Column) -> Column:
    """<weekday>, ngày <dd> tháng <mm> năm <yyyy>."""
    weekday = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek(at))
    return F.concat(weekday, F.date_format(at, "', ngày 'dd' tháng 'MM' năm 'yyyy"))


def as_json(row: Column) -> Column:
    """A result struct as JSON; fields that are null are left out, at any depth."""
    return F.to_json(row, {"ignoreNullFields": "true"})
