"""Pascal VOC annotations: relative boxes to pixel boxes and back, XML rows and files, and joining files to images by stem."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError

BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
ANNOTATIONS = f"array<struct<label:string,bbox:{BOX},format:string,source:string,difficult:int,truncated:int,pose:string>>"
XML = "struct<filename:string,size:struct<width:int,height:int,depth:int>,object:array<struct<name:string,pose:string,truncated:int,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>"


def to_pixels(annotations: Column | str, width: Column | str, height: Column | str) -> Column:
    """Relative boxes as pixel boxes, rounded half to even and kept inside the image."""
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    at = lambda v, side: F.least(F.greatest(F.rint(v * side), F.lit(0.0)), side.cast("double")).cast("int")
    return F.transform(annotations, lambda a: F.struct(a["label"].alias("name"), F.coalesce(a["pose"], F.lit("Unspecified")).alias("pose"), F.coalesce(a["truncated"], F.lit(0)).alias("truncated"), F.coalesce(a["difficult"], F.lit(0)).alias("difficult"), F.struct(at(a["bbox"]["x_min"], w).alias("xmin"), at(a["bbox"]["y_min"], h).alias("ymin"), at(a["bbox"]["x_max"], w).alias("xmax"), at(a["bbox"]["y_max"], h).alias("ymax")).alias("bndbox")))


def to_relative(objects: Column | str, width: Column | str, height: Column | str, source: str = "pascal_voc") -> Column:
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    return F.transform(objects, lambda o: F.struct(o["name"].alias("label"), F.struct((o["bndbox"]["xmin"] / w).alias("x_min"), (o["bndbox"]["ymin"] / h).alias("y_min"), (o["bndbox"]["xmax"] / w).alias("x_max"), (o["bndbox"]["ymax"] / h).alias("y_max")).alias("bbox"), F.lit("relative").alias("format"), F.lit(source).alias("source"), o["difficult"].alias("difficult"), o["truncated"].alias("truncated"), o["pose"].alias("pose")))


def box_errors(annotations: Column | str) -> Column:
    """The annotations whose label is empty or whose box is not a proper part of the unit square."""
    def bad(a: Column) -> Column:
        b = a["bbox"]
        inside = (b["x_min"] >= 0) & (b["y_min"] >= 0) & (b["x_max"] <= 1) & (b["y_max"] <= 1) & (b["x_min"] < b["x_max"]) & (b["y_min"] < b["y_max"])
        return (F.coalesce(F.trim(a["label"]), F.lit("")) == "") | ~F.coalesce(inside, F.lit(False))

    return F.filter(annotations, bad)


def to_xml(file_name: Column, width: Column, height: Column, objects: Column) -> Column:
    """One VOC document for each row."""
    doc = F.struct(file_name.alias("filename"), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), F.lit(3).alias("depth")).alias("size"), objects.alias("object"))
    return F.to_xml(doc, {"rowTag": "annotation"})


def stem(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def export_labelimg(df: DataFrame, folder: str) -> str:
    """folder/images and an XML file beside each annotated image, and folder/raw.parquet. `df` has image_id, content, image_uri, width,
    height and annotations; ids must be there and unique. Files are written in the tasks to a mounted folder."""
    broken = df.groupBy("image_id").count().where("image_id is null or trim(image_id) = '' or count > 1").first()
    if broken:
        raise ValidationError(f"image ids must be unique and not empty: {broken['image_id']!r}")
    ext = F.lower(F.regexp_extract("image_uri", r"(\.[A-Za-z0-9]+)$", 1))
    xml = F.when(F.size("annotations") > 0, to_xml(F.concat("image_id", ext), F.col("width"), F.col("height"), to_pixels("annotations", "width", "height")))
    files = df.select(F.concat(F.lit("images/"), "image_id", ext).alias("name"), F.concat(F.lit("images/"), "image_id", F.lit(".xml")).alias("xml_name"), "content", xml.alias("xml"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            os.makedirs(f"{folder}/images", exist_ok=True)
            for r in frame.itertuples():
                for name, data in ((r.name, r.content), (r.xml_name, r.xml.encode() if r.xml else None)):
                    if data is not None:
                        with open(f"{folder}/{name}", "wb") as f:
                            f.write(bytes(data))
            yield pd.DataFrame({"n": [len(frame)]})

    files.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    df.drop("content").write.mode("overwrite").parquet(f"{folder}/raw.parquet")
    return folder


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """stem, width, height and objects of each XML file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    doc = F.from_xml(F.decode("content", "utf-8"), XML.removeprefix("struct<").removesuffix(">").replace("filename:", "filename ").replace(",size:", ", size ").replace(",object:", ", object "))
    return files.select(stem("path").alias("stem"), doc.alias("doc")).select("stem", F.col("doc.size.width").alias("width"), F.col("doc.size.height").alias("height"), F.col("doc.object").alias("objects"))


def attach(images: DataFrame, voc: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Images with the annotations of the file that has their stem, and the report: files without an image, and files whose size is not the
    image's (which are not attached; with `strict` either is an error)."""
    v = voc.select("stem", F.col("width").alias("_w"), F.col("height").alias("_h"), "objects")
    rows = images.withColumn("_stem", stem("image_uri"))
    joined = rows.join(v, F.col("_stem") == F.col("stem"), "left").withColumn("_fits", (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")))
    made = F.when(F.coalesce("_fits", F.lit(False)), to_relative("objects", "width", "height")).otherwise(F.array().cast(ANNOTATIONS))
    report = (
        v.join(rows, F.col("_stem") == F.col("stem"), "left_anti").select("stem", F.lit("no image").alias("problem"))
        .union(joined.where("stem is not null and not coalesce(_fits, false)").select("stem", F.lit("size differs")))
    )
    if strict and (first := report.first()):
        raise ValidationError(f"{first['stem']}: {first['problem']}")
    return joined.withColumn("annotations", made).drop("_stem", "stem", "_w", "_h", "objects", "_fits"), report
