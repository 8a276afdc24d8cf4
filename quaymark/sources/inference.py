"""Model stages.  A recogniser or detector is any object with a `batch` method; it is made once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Recogniser(Protocol):
    def batch(self, images: list[bytes]) -> list[list[tuple[str, float]]]:
        """For each image its (text, score) pairs in reading order."""


class Detector(Protocol):
    def batch(self, images: list[bytes]) -> list[list[tuple[float, int, int, int, int]]]:
        """For each image its boxes (confidence, x1, y1, x2, y2)."""


class Decoder(Protocol):
    def size(self, image: bytes) -> tuple[int, int] | None:
        """Height and width of a picture; none if it cannot be decoded."""


def decoded(images: DataFrame, make: Callable[[], Decoder]) -> DataFrame:
    """Images (image_id, content) with `decoded`, `height` and `width`; contents that are missing, broken or make the decoder raise are not decoded.

    Contents stay in their tasks; the columns beside them come through.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = make()

        def size(content) -> tuple[int, int] | None:
            try:
                return decoder.size(bytes(content)) if content is not None else None
            except Exception:  # noqa: BLE001  a decoder may raise anything
                return None

        for pdf in frames:
            sizes = [size(c) for c in pdf["content"]]
            yield pdf.assign(decoded=[s is not None for s in sizes], height=pd.array([s[0] if s else None for s in sizes], "Int32"), width=pd.array([s[1] if s else None for s in sizes], "Int32"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    return images.mapInPandas(run, f"{kinds}, decoded boolean, height int, width int")


def recognise(images: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """(image_id, ord, text, score) rows from (image_id, content); equal contents are recognised once.

    Digests are taken where the contents are read, and one image of each content is chosen from ids and digests alone.  The
    others are then left out of a second reading, and the contents go from the reader to the recogniser: what is joined and
    grouped are ids, digests and tokens.  (Only if the ids to leave out are too many for Spark to broadcast does it move
    contents, by id.)  If a batch fails its images are tried one by one, and one that fails alone gives no tokens.
    `image_id` must be unique.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            contents = list(pdf["content"])
            try:
                found = model.batch(contents)
            except Exception:  # noqa: BLE001  a model may raise anything
                found = []
                for c in contents:
                    try:
                        found += model.batch([c])
                    except Exception:  # noqa: BLE001
                        found.append([])
            rows = [(i, k, t, float(s)) for i, pairs in zip(pdf["image_id"], found, strict=True) for k, (t, s) in enumerate(pairs)]
            yield pd.DataFrame(rows, columns=["reader", "ord", "text", "score"])

    kind = images.schema["image_id"].dataType.simpleString()
    digests = images.select("image_id", F.sha2("content", 256).alias("digest"))
    chosen = digests.groupBy("digest").agg(F.min("image_id").alias("reader"))
    readers = digests.join(chosen, digests["digest"].eqNullSafe(chosen["digest"])).select("image_id", "reader")
    again = readers.where("image_id <> reader").select("image_id")
    tokens = images.select("image_id", "content").join(again, "image_id", "left_anti").mapInPandas(run, f"reader {kind}, ord int, text string, score double")
    return readers.join(tokens, "reader").select("image_id", "ord", "text", "score")


def detect(images: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """(image_id, ord, conf, x1, y1, x2, y2) rows, most confident first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            rows = [(i, k, *map(float, b[:1]), *map(int, b[1:])) for i, boxes in zip(pdf["image_id"], model.batch(list(pdf["content"])), strict=True) for k, b in enumerate(sorted(boxes, key=lambda b: -b[0]))]
            yield pd.DataFrame(rows, columns=["image_id", "ord", "conf", "x1", "y1", "x2", "y2"])

    return images.select("image_id", "content").mapInPandas(run, "image_id string, ord int, conf double, x1 int, y1 int, x2 int, y2 int")


def top_crop(detections: DataFrame, dims: DataFrame) -> DataFrame:
    """The most confident box of each image inside the image; empty boxes are passed over."""
    from quaymark.operators.boxes import clamp
    from quaymark.operators.ranking import best

    rows = detections.join(dims, "image_id").withColumn("box", clamp("x1", "y1", "x2", "y2", "width", "height")).where("box is not null")
    return best(rows, ["image_id"], "conf", ["ord"]).select("image_id", "conf", "box.*")


def crops(detections: DataFrame, dims: DataFrame, most: int = 8) -> DataFrame:
    """(image_id, crop, conf, x1, y1, x2, y2): up to `most` boxes of each image that lie inside it, most confident first, numbered from 0.

    `most` is the setting `max_crops_per_image`; with `use_crop_service` off a whole image is its only crop (see `whole`).
    """
    from quaymark.operators.boxes import clamp

    rows = detections.join(dims, "image_id").withColumn("box", clamp("x1", "y1", "x2", "y2", "width", "height")).where("box is not null")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("conf").desc(), "ord")) - 1
    return rows.withColumn("crop", place).where(F.col("crop") < most).select("image_id", "crop", "conf", "box.*")


def whole(dims: DataFrame) -> DataFrame:
    """Each image as its own crop."""
    return dims.select("image_id", F.lit(0).alias("crop"), F.lit(1.0).alias("conf"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"))


def crop_layouts(crops_: DataFrame, dims: DataFrame, two_bands: DataFrame, mode: str = "container") -> DataFrame:
    """(image_id, image_type): the layout of the first crop that has a known one, else that of the whole image, else unknown.

    `two_bands` is (image_id, crop, two_bands), crop -1 for the whole image.
    """
    from quaymark.operators import ranking, routing

    bands = F.coalesce("two_bands", F.lit(False))
    each = crops_.join(two_bands, ["image_id", "crop"], "left").withColumn("layout", routing.layout(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), bands))
    first = ranking.best(each.where("layout <> 'unknown'"), ["image_id"], F.lit(0), ["crop"]).select("image_id", F.col("layout").alias("crop_layout"))
    direct = dims.join(two_bands.where("crop = -1").drop("crop"), "image_id", "left").select("image_id", routing.layout(F.col("width"), F.col("height"), bands).alias("direct_layout"))
    return direct.join(first, "image_id", "left").select("image_id", routing.image_type(F.lit(mode), F.col("crop_layout"), F.col("direct_layout")).alias("image_type"))
