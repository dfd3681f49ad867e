"""Scalar functions. All are Column expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no value, lower case.
NO_VALUE = ("", "na", "n/a", "nan", "none", "null")
#: Names of splits in the order in which they are looked for, and what they mean.
SPLIT_NAMES = {"train": "train", "val": "val", "valid": "val", "validation": "val", "test": "test"}
#: Words for yes and no.
YES, NO = ("1", "true", "yes", "y", "positive"), ("0", "false", "no", "n", "negative")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_id(dataset: Column | str, path: Column | str) -> Column:
    """dataset::path, with forward slashes."""
    return F.concat_ws("::", col(dataset), F.replace(col(path), F.lit("\\"), F.lit("/")))


def normalize_na(c: Column | str) -> Column:
    """Null for the texts that stand for no value; else the trimmed text."""
    text = F.trim(col(c).cast("string"))
    return F.when(F.lower(text).isin(*NO_VALUE), None).otherwise(text)


def path_part(path: Column | str, from_end: int, default: str | None = None) -> Column:
    """The part of a path counted from its end, from 1."""
    parts = F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/")
    found = F.when(F.size(parts) >= from_end, F.element_at(parts, -from_end))
    return found if default is None else F.coalesce(F.when(found != "", found), F.lit(default))


def infer_split(path: Column | str) -> Column:
    """The split that a path names; earlier names of SPLIT_NAMES win over places in the path."""
    parts = F.split(F.lower(F.replace(col(path), F.lit("\\"), F.lit("/"))), "/")
    out = None
    for name, meaning in SPLIT_NAMES.items():
        hit = F.array_contains(parts, name)
        out = F.when(hit, meaning) if out is None else out.when(hit, meaning)
    return out.otherwise(None)


def stem(path: Column | str) -> Column:
    return F.regexp_extract(path_part(path, 1), r"^(.*?)(\.[^.]*)?$", 1)


def is_image(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1)).isin(*IMAGE_SUFFIXES)


def is_skipped(path: Column | str, folders: Iterable[str] = ("__macosx", ".git", ".ipynb_checkpoints", "__pycache__")) -> Column:
    """Junk folders, resource forks and files of desktops."""
    parts = F.split(F.lower(F.replace(col(path), F.lit("\\"), F.lit("/"))), "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in folders])) | name.startswith("._") | name.isin(".ds_store", "thumbs.db")


def norm_label(c: Column | str) -> Column:
    """true and false in lower case and trimmed; any other text as it is, spaces included."""
    c = col(c).cast("string")
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "false"), low).otherwise(c)


def norm_value(c: Column | str) -> Column:
    """A whole number, cut towards zero."""
    return col(c).try_cast("double").cast("int")


def truth(c: Column | str) -> Column:
    """1 only for numbers whose whole part is 1 and for the words true, yes, positive; 0 for all else."""
    text = F.lower(F.trim(col(c).cast("string")))
    number = text.try_cast("double")
    return F.when(number.isNotNull(), (number.cast("long") == 1).cast("int")).otherwise(text.isin("true", "yes", "positive").cast("int"))


def strict_flag(c: Column | str, what: str = "label") -> Column:
    """1 or 0; any other text is an error."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin(*YES), 1).when(text.isin(*NO), 0).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(text, F.lit("null")))).cast("int"))


def group_id(dataset: Column | str, digest: Column | str, template: str = "dup::{dataset}::{md5}") -> Column:
    """A template with {dataset} and {md5}."""
    out, rest = [], template
    while rest:
        at = min((rest.find(k) for k in ("{dataset}", "{md5}") if k in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        if at:
            out.append(F.lit(rest[:at]))
        key = "{dataset}" if rest.startswith("{dataset}", at) else "{md5}"
        out.append(col(dataset) if key == "{dataset}" else col(digest))
        rest = rest[at + len(key) :]
    return F.concat(*out)


def hash_hex(seed: int | str, text: Column | str) -> Column:
    """The first 16 hex digits of md5(seed::text): their order is that of the unsigned 64-bit number."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}::"), col(text).cast("string"))), 1, 16)


def stable_hash(seed: int | str, text: Column | str) -> Column:
    """That number; it does not fit a BIGINT."""
    return F.conv(hash_hex(seed, text), 16, 10).cast("decimal(20,0)")


def sample_seed(text: Column | str, base: int) -> Column:
    return F.conv(F.substring(F.md5(col(text).cast("string")), 1, 8), 16, 10).cast("long") + F.lit(base)


def band(p: Column | str, clear: float, retake: float, names: tuple[str, str, str] = ("false", "uncertain", "true")) -> Column:
    """Three states of a probability; null and NaN have none."""
    if not clear < retake:
        raise ValueError(f"the lower threshold {clear} is not below the upper {retake}")
    p = col(p)
    return F.when(p.isNull() | F.isnan(p), None).when(p <= clear, names[0]).when(p >= retake, names[2]).otherwise(names[1])


def logistic(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def yolo_box(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners of a relative box, clipped to the image."""
    zero = F.lit(0.0)
    return {
        "x_min": F.greatest(zero, (xc - w / 2) * width),
        "y_min": F.greatest(zero, (yc - h / 2) * height),
        "x_max": F.least(width.cast("double"), (xc + w / 2) * width),
        "y_max": F.least(height.cast("double"), (yc + h / 2) * height),
    }


def box_ratios(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    return {
        "bbox_width_ratio": (x1 - x0) / width,
        "bbox_height_ratio": (y1 - y0) / height,
        "bbox_area_ratio": (x1 - x0) * (y1 - y0) / (width * height),
        "touches_border": (x0 <= 0) | (y0 <= 0) | (x1 >= width) | (y1 >= height),
    }


def expand_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float) -> dict[str, Column]:
    """A box grown by a share of its sides, to whole pixels, clipped; an empty one is an error."""
    dx, dy = (x1 - x0) * margin, (y1 - y0) * margin
    out = {
        "x_min": F.greatest(F.lit(0), F.floor(x0 - dx)),
        "y_min": F.greatest(F.lit(0), F.floor(y0 - dy)),
        "x_max": F.least(width, F.ceil(x1 + dx)),
        "y_max": F.least(height, F.ceil(y1 + dy)),
    }
    fine = (out["x_max"] > out["x_min"]) & (out["y_max"] > out["y_min"])
    return {k: F.when(fine, v).otherwise(F.raise_error(F.lit("an expanded box is empty")).cast("long")) for k, v in out.items()}


def letterbox(width: Column, height: Column, target_width: int, target_height: int) -> dict[str, Column]:
    """Scale, new size and padding of an image in a frame; sizes are rounded half to even."""
    scale = F.least(F.lit(target_width) / width, F.lit(target_height) / height)
    w = F.greatest(F.lit(1), F.bround(width * scale, 0).cast("int"))
    h = F.greatest(F.lit(1), F.bround(height * scale, 0).cast("int"))
    left, top = F.floor((F.lit(target_width) - w) / 2).cast("int"), F.floor((F.lit(target_height) - h) / 2).cast("int")
    return {"scale": scale, "resized_width": w, "resized_height": h, "pad_left": left, "pad_top": top, "pad_right": F.lit(target_width) - w - left, "pad_bottom": F.lit(target_height) - h - top}


def keyword_hits(text: Column | str, keywords: Iterable[str], first: int = 20_000, most: int = 50) -> Column:
    """The distinct keywords in the first characters of a text, in order of the list: a probe of a file's head, and limited as such."""
    head = F.lower(F.substring(col(text), 1, first))
    words = F.array(*[F.lit(k.lower()) for k in dict.fromkeys(keywords)])
    return F.slice(F.filter(words, lambda k: F.contains(head, k)), 1, most)


def member(c: Column | str, known: Iterable[str], what: str) -> Column:
    """The text if it is known; an error if not."""
    c = col(c)
    return F.when(c.isin(*known), c).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(c, F.lit("null")))))


def not_phenotype(reason: Column | str, words: Iterable[str], parts: Iterable[str]) -> Column:
    """A reason code, unless it is or contains a word that describes the subject and not the picture."""
    low = F.lower(col(reason))
    bad = low.isin(*words)
    for p in parts:
        bad = bad | F.contains(low, F.lit(p))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a reason about quality: "), low))).otherwise(col(reason))


def lookup(c: Column | str, table: Mapping[str, str], default: str | None = None) -> Column:
    """A small fixed map as a literal."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), col(c)) if pairs else F.lit(None).cast("string")
    return found if default is None else F.coalesce(found, F.lit(default))


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def warmup(step: Column | str, steps: int, kind: str = "linear", gamma: float = 10.0) -> Column:
    """A schedule from 0 to 1: linear, or 2 / (1 + exp(-gamma p)) - 1."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(step) / F.lit(float(max(steps, 1)))))
    return p if kind == "linear" else 2 / (1 + F.exp(-gamma * p)) - 1
