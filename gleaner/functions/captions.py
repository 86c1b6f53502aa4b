"""Caption text and sample files."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The file suffixes that count as an image, in order of preference, and the
# suffix of the caption.
IMAGE_SUFFIXES = ["jpg", "png", "jpeg", "webp"]
CAPTION_SUFFIX = "txt"

# Fixed value: the word pattern of the caption tokenizer. Case is ignored.
TOKEN_PATTERN = (
    r"<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
)

# The short list of prompt templates.
SIMPLE_TEMPLATES = [
    "itap of a {}.",
    "a bad photo of the {}.",
    "a origami {}.",
    "a photo of the large {}.",
    "a {} in a video game.",
    "art of the {}.",
    "a photo of the small {}.",
]

# The full list of prompt templates.
PROMPT_TEMPLATES = [
    "a bad photo of a {}.",
    "a photo of many {}.",
    "a sculpture of a {}.",
    "a photo of the hard to see {}.",
    "a low resolution photo of the {}.",
    "a rendering of a {}.",
    "graffiti of a {}.",
    "a bad photo of the {}.",
    "a cropped photo of the {}.",
    "a tattoo of a {}.",
    "the embroidered {}.",
    "a photo of a hard to see {}.",
    "a bright photo of a {}.",
    "a photo of a clean {}.",
    "a photo of a dirty {}.",
    "a dark photo of the {}.",
    "a drawing of a {}.",
    "a photo of my {}.",
    "the plastic {}.",
    "a photo of the cool {}.",
    "a close-up photo of a {}.",
    "a black and white photo of the {}.",
    "a painting of the {}.",
    "a painting of a {}.",
    "a pixelated photo of the {}.",
    "a sculpture of the {}.",
    "a bright photo of the {}.",
    "a cropped photo of a {}.",
    "a plastic {}.",
    "a photo of the dirty {}.",
    "a jpeg corrupted photo of a {}.",
    "a blurry photo of the {}.",
    "a photo of the {}.",
    "a good photo of the {}.",
    "a rendering of the {}.",
    "a {} in a video game.",
    "a photo of one {}.",
    "a doodle of a {}.",
    "a close-up photo of the {}.",
    "a photo of a {}.",
    "the origami {}.",
    "the {} in a video game.",
    "a sketch of a {}.",
    "a doodle of the {}.",
    "a origami {}.",
    "a low resolution photo of a {}.",
    "the toy {}.",
    "a rendition of the {}.",
    "a photo of the clean {}.",
    "a photo of a large {}.",
    "a rendition of a {}.",
    "a photo of a nice {}.",
    "a photo of a weird {}.",
    "a blurry photo of a {}.",
    "a cartoon {}.",
    "art of a {}.",
    "a sketch of the {}.",
    "a embroidered {}.",
    "a pixelated photo of a {}.",
    "itap of the {}.",
    "a jpeg corrupted photo of the {}.",
    "a good photo of a {}.",
    "a plushie {}.",
    "a photo of the nice {}.",
    "a photo of the small {}.",
    "a photo of the weird {}.",
    "the cartoon {}.",
    "art of the {}.",
    "a drawing of the {}.",
    "a photo of the large {}.",
    "a black and white photo of a {}.",
    "the plushie {}.",
    "a dark photo of a {}.",
    "itap of a {}.",
    "graffiti of the {}.",
    "a toy {}.",
    "itap of my {}.",
    "a photo of a cool {}.",
    "a photo of a small {}.",
    "a tattoo of the {}.",
]


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _unescape_twice(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(html.unescape(t)) if t and "&" in t else t)


def clean_caption(text: Column | str) -> Column:
    """Entities resolved twice, runs of white space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_unescape_twice(_column(text)), r"(?U)\s+", " ")))


def caption_tokens(text: Column | str) -> Column:
    """Words, contractions, single digits and other runs of a cleaned caption."""
    return F.regexp_extract_all(_column(text), F.lit(f"(?iU){TOKEN_PATTERN}"), F.lit(0))


def has_caption_and_image(files: Column | str) -> Column:
    """Whether a sample's files include a caption and at least one image."""
    files = _column(files)
    image = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        image = image | F.map_contains_key(files, suffix)
    return F.map_contains_key(files, CAPTION_SUFFIX) & image


def pick_image(files: Column | str) -> Column:
    """The first image present, in order of preference."""
    return F.coalesce(*[F.try_element_at(_column(files), F.lit(s)) for s in IMAGE_SUFFIXES])


def pick_caption(files: Column | str) -> Column:
    return F.try_element_at(_column(files), F.lit(CAPTION_SUFFIX))


def prompt_expand(
    classes: DataFrame, templates: list[str] | None = None, name: str = "class_name"
) -> DataFrame:
    """Every template filled with every class name, one row each."""
    listed = F.array(*[F.lit(t) for t in (templates or PROMPT_TEMPLATES)])
    return classes.select("*", F.posexplode(listed).alias("template_id", "template")).select(
        *classes.columns,
        "template_id",
        F.replace(F.col("template"), F.lit("{}"), F.col(name)).alias("prompt"),
    )
