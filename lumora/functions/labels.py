"""Labels of detected objects, and titles of label albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display labels by class name. Two classes share one label.
LABELS: dict[str, str] = {
    "person": "người",
    "bicycle": "xe đạp",
    "car": "ô tô",
    "motorcycle": "xe máy",
    "airplane": "máy bay",
    "bus": "xe buýt",
    "train": "tàu hỏa",
    "truck": "xe tải",
    "boat": "thuyền",
    "traffic light": "đèn giao thông",
    "fire hydrant": "trụ cứu hỏa",
    "stop sign": "biển báo dừng",
    "parking meter": "đồng hồ đỗ xe",
    "bench": "ghế dài",
    "bird": "chim",
    "cat": "mèo",
    "dog": "chó",
    "horse": "ngựa",
    "sheep": "cừu",
    "cow": "bò",
    "elephant": "voi",
    "bear": "gấu",
    "zebra": "ngựa vằn",
    "giraffe": "hươu cao cổ",
    "backpack": "ba lô",
    "umbrella": "ô",
    "handbag": "túi xách",
    "tie": "cà vạt",
    "suitcase": "vali",
    "frisbee": "đĩa bay",
    "skis": "ván trượt tuyết",
    "snowboard": "ván trượt tuyết",
    "sports ball": "bóng thể thao",
    "kite": "diều",
    "baseball bat": "gậy bóng chày",
    "baseball glove": "găng tay bóng chày",
    "skateboard": "ván trượt",
    "surfboard": "ván lướt sóng",
    "tennis racket": "vợt tennis",
    "bottle": "chai",
    "wine glass": "ly rượu",
    "cup": "cốc",
    "fork": "nĩa",
    "knife": "dao",
    "spoon": "thìa",
    "bowl": "bát",
    "banana": "chuối",
    "apple": "táo",
    "sandwich": "bánh mì kẹp",
    "orange": "cam",
    "broccoli": "bông cải xanh",
    "carrot": "cà rốt",
    "hot dog": "hot dog",
    "pizza": "pizza",
    "donut": "bánh donut",
    "cake": "bánh ngọt",
    "chair": "ghế",
    "couch": "ghế sofa",
    "potted plant": "cây trồng trong chậu",
    "bed": "giường",
    "dining table": "bàn ăn",
    "toilet": "bồn cầu",
    "tv": "tivi",
    "laptop": "máy tính xách tay",
    "mouse": "chuột máy tính",
    "remote": "điều khiển từ xa",
    "keyboard": "bàn phím",
    "cell phone": "điện thoại di động",
    "microwave": "lò vi sóng",
    "oven": "lò nướng",
    "toaster": "máy nướng bánh mì",
    "sink": "bồn rửa",
    "refrigerator": "tủ lạnh",
    "book": "sách",
    "clock": "đồng hồ",
    "vase": "bình hoa",
    "scissors": "kéo",
    "teddy bear": "gấu bông",
    "hair drier": "máy sấy tóc",
    "toothbrush": "bàn chải đánh răng",
}


def display_label(name: Column) -> Column:
    """The display label of a class name (trimmed for the look-up); an unknown name stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(name)), name)


def class_name(df: DataFrame, names: DataFrame, number: str = "class_no") -> DataFrame:
    """df with the detector's class names (a table number, name); a number without a name is cls_<number>."""
    return df.join(names.select(F.col("number").alias(number), F.col("name").alias("_name")), number, "left").withColumn("class_name", F.coalesce("_name", F.concat(F.lit("cls_"), F.col(number).cast("string")))).drop("_name")


#: Classes that a model without a readable dictionary has.
UNNAMED = 80


def model_classes(content: Column) -> Column:
    """The class names in a model file's bytes, by number: the first {0: 'a', 1: 'b', ...} in it. Numbers that it leaves out are cls_<number>;
    without a dictionary there are UNNAMED of those."""
    found = F.regexp_extract(content.cast("string"), r"(\{0: '[^}]*\})", 1)
    # Entries follow one another; what comes after one that isn't an entry is no part of the dictionary.
    whole = F.regexp_extract(found, r"^(\{[0-9]+: '[^']*'(?:[, {]+[0-9]+: '[^']*')*)", 1)
    part = lambda group: F.regexp_extract_all(whole, F.lit(r"([0-9]+): '([^']*)'"), F.lit(group))
    entries = F.arrays_zip(F.transform(part(1), lambda x: x.cast("int")).alias("number"), part(2).alias("name"))
    top = F.when(F.size(entries) > 0, F.array_max(entries["number"])).otherwise(UNNAMED - 1)
    named = lambda i: F.try_element_at(F.filter(entries, lambda e: e["number"] == i), F.lit(-1))["name"]
    return F.transform(F.sequence(F.lit(0), top), lambda i: F.coalesce(named(i), F.concat(F.lit("cls_"), i.cast("string"))))
