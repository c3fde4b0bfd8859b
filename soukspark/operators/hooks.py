"""Places where a hosted model would answer: a function over batches, and deterministic stand-ins for it."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soukspark.functions import text


#: Images of a product that are asked about, at most; calls of a task that are under way at once.
CEILING, IN_FLIGHT = 200, 8


def classify(pool: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], answers: str | None = None) -> DataFrame:
    """``product, i, role, needs_clean`` of images (``product, i, url, batch``), the first ``CEILING`` of a product.

    A call is one batch of a product; a task has ``IN_FLIGHT`` of them under way, since a hosted model's answers are waited
    for. A batch whose call fails gives no rows, and the others theirs. Answers for places that were not asked are dropped.

    ``answers``: a folder that all executors reach, where each call's answer is kept under a digest of its URLs as soon as it
    is there. A task that runs again, or a later run with the same batches, asks only for what is not there.

    A model with ``rowwise`` set answers each image by itself, in order, and takes many batches in one call.
    """
    out = ["product", "i", "role", "needs_clean"]

    def of(frames: Iterator[pd.DataFrame]):
        kept = Answers(answers) if answers else None

        def asked(part: pd.DataFrame) -> list[tuple]:
            places = part["i"].tolist()
            name = hashlib.sha256("\n".join(part["url"].fillna("").tolist()).encode()).hexdigest()
            got = kept.get(name) if kept else None
            try:
                if got is None:
                    # places within the call, so that an answer holds for any product with these images
                    said, at = model(part), {i: k for k, i in enumerate(places)}
                    said = zip(said["i"].tolist(), said["role"].tolist(), said["needs_clean"].tolist(), strict=True)
                    got = [(at[i], role, bool(clean)) for i, role, clean in said if i in at]
                    if kept:
                        kept.put(name, got)
            except (OSError, ValueError):
                return []
            product = part["product"].iloc[0]
            return [(product, places[k], role, clean) for k, role, clean in got if 0 <= k < len(places)]

        def at_once(f: pd.DataFrame) -> pd.DataFrame | None:
            try:
                said = model(f)
            except (OSError, ValueError):
                return None  # call by call, so that only those that fail are missing
            return said[out] if said["i"].tolist() == f["i"].tolist() else None

        rowwise = getattr(model, "rowwise", False) and kept is None
        with ThreadPoolExecutor(IN_FLIGHT) as calls:
            for f in frames:
                f = f[f["product"].notna() & f["batch"].notna()]
                if rowwise and (said := at_once(f)) is not None:
                    yield said
                    continue
                keys = f[["product", "batch"]].to_numpy()  # sorted by them
                edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(f)]
                got = calls.map(asked, [f.iloc[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b])
                yield pd.DataFrame([r for rows in got for r in rows], columns=out)

    # a call's images in one task; a product's calls over many
    first = F.row_number().over(Window.partitionBy("product").orderBy("i"))
    asked = pool.withColumn("_nth", first).where(F.col("_nth") <= CEILING).drop("_nth").repartition("product", "batch")
    return asked.sortWithinPartitions("product", "batch", "i").mapInPandas(_whole(of, ["product", "batch"]), "product long, i int, role string, needs_clean boolean")


def _whole(of: Callable, keys: list[str]) -> Callable:
    """Lets ``of`` see frames that end where a group of rows ends, so that no call is split over two."""

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            last = f[keys].eq(f[keys].iloc[-1]).all(axis=1)
            rest = f[last]
            if not last.all():
                yield f[~last]
        if rest is not None and len(rest):
            yield rest

    return lambda frames: of(held(frames))


class Answers:
    """Answers in a folder of any file system that Arrow reads, one small file each; a file appears whole or not at all."""

    def __init__(self, path: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.fs.create_dir(self.path)

    def get(self, name: str) -> list | None:
        if self.fs.get_file_info(f"{self.path}/{name}").type == pyarrow.fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def put(self, name: str, answer: list) -> None:
        own = f"{self.path}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as f:
            f.write(json.dumps(answer).encode())
        self.fs.move(own, f"{self.path}/{name}")


def stub_classifier(part: pd.DataFrame) -> pd.DataFrame:
    """Roles by a checksum of the URL."""
    h = np.fromiter((int(hashlib.md5(u.encode()).hexdigest()[:8], 16) for u in part["url"].tolist()), np.int64, len(part))
    return part.assign(role=np.array(["cover", "dimension", "skip"], object)[h % 3], needs_clean=h // 3 % 4 == 0)


stub_classifier.rowwise = True


def stub_cleaner(urls: pd.Series) -> pd.Series:
    """A cleaned image for each URL but those whose number is a multiple of five."""
    return urls.where(urls.str.extract(r"(\d+)$")[0].astype(float) % 5 != 0) + "#clean"


def copy_text(rows: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """``rows`` with ``ai_title`` and ``ai_description``. Title by the model (a stand-in: the title), first line, cut to
    whole segments; description from the template. In: ``title, edt_min, edt_max, variant_names``."""
    raw = F.pandas_udf(model, "string")("title") if model else F.col("title")
    return rows.withColumns({"ai_title": text.cut_title(text.first_line(raw)), "ai_description": text.fixed_description(text.delivery_line("edt_min", "edt_max"), "variant_names")})


def regenerate(listings: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Listings whose AI title is missing get one; the others stay as they are."""
    raw = F.pandas_udf(model, "string")("title") if model else F.col("title")
    return listings.withColumn("ai_title", F.when(F.coalesce("ai_title", F.lit("")) == "", text.cut_title(text.first_line(raw))).otherwise(F.col("ai_title")))


def clean(covers: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``product, url, cleaned_url`` of covers to be cleaned; no answer counts as failed."""
    return covers.where("needs_clean").select("product", "url", F.pandas_udf(model, "string")("url").alias("cleaned_url"))


def shot_counts(made: DataFrame, want: int) -> DataFrame:
    """``id, passed, rejected``: rejected counts all that were wanted and did not pass."""
    return made.groupBy("id").agg(F.count("shot_url").alias("passed")).withColumn("rejected", F.lit(want) - F.col("passed"))
