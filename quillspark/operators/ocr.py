"""Text recognition: providers, the decisions whether a page needs it, calligraphy, and the choice between two texts.

Null texts count as empty and null flags as false; nothing is cut; no operator here shuffles but glyph_metrics, by page.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import text_quality

# Parts of font names that tell a script.
CALLIGRAPHY = (("Nastaliq", ("nastaliq", "nastaleeq", "nafees", "jameel", "kasheeda", "shekasteh", "farsi_nastaliq", "iranian")), ("Diwani", ("diwan", "diwani")),
               ("Thuluth", ("thuluth",)), ("Ruqah", ("ruqaa", "ruq'ah", "reqa")))
CORRUPT = r"\x{FFFD}\x{E000}-\x{F8FF}"


# --- providers


@dataclass(frozen=True)
class Recognized:
    text: str
    confidence: float
    language: str = ""

    def lines(self) -> list[list[str]]:
        """The words of each line that isn't blank."""
        return [x.split() for x in self.text.splitlines() if x.strip()]


class Provider(ABC):
    """Recognises images. An instance travels to the executors, so it must be picklable."""

    name = "provider"

    def is_available(self) -> bool:
        return True

    @abstractmethod
    def recognize(self, image: bytes, language: str | None = None, dpi: int = 150) -> Recognized: ...


class MockProvider(Provider):
    """The same answer to every image, for tests."""

    name = "mock"

    def __init__(self, text: str = "Mock OCR extracted text", confidence: float = 0.95):
        self.text, self.confidence = text, confidence

    def recognize(self, image, language=None, dpi=150):
        return Recognized(self.text, self.confidence, "English")


class TesseractProvider(Provider):
    """The system's program, one process for an image; where it isn't installed, is_available is false."""

    name = "tesseract"
    PLACES = ("/usr/bin/tesseract", "/usr/local/bin/tesseract", "/opt/homebrew/bin/tesseract")

    def __init__(self, binary: str | None = None, languages: str = "ara+eng", timeout: int = 120):
        self.binary, self.languages, self.timeout = binary, languages, timeout

    def resolve(self) -> str | None:
        for c in (self.binary, os.environ.get("TESSERACT_PATH"), shutil.which("tesseract"), *self.PLACES):
            if c and os.path.exists(c):
                return c
        return None

    def is_available(self):
        return self.resolve() is not None

    def recognize(self, image, language=None, dpi=150):
        binary = self.resolve()
        if binary is None:
            raise RuntimeError("tesseract is not installed (TESSERACT_PATH names it)")
        with tempfile.NamedTemporaryFile(suffix=".jpg") as f:  # the program wants a file; it goes with the call
            f.write(image)
            f.flush()
            out = subprocess.run([binary, f.name, "stdout", "-l", language or self.languages, "--dpi", str(dpi)], capture_output=True, timeout=self.timeout, check=True)
        return Recognized(out.stdout.decode("utf-8", "replace").strip(), 0.90, language or self.languages)


# --- decisions


def needed(mode: str, text_bytes: Column, images: Column, scanned: Column, least: int = 20) -> Column:
    """The gate in front of recognition: never, always, or auto: little text beside an image or on a scanned page."""
    if mode in ("never", "always"):
        return F.lit(mode == "always")
    return (F.coalesce(text_bytes, F.lit(0)) < least) & (F.coalesce(scanned, F.lit(False)) | (F.coalesce(images, F.lit(0)) > 0))


def necessity(text: Column, spans: Column, images: Column, scanned: Column, counts=None) -> dict[str, Column]:
    """should_ocr, necessity, is_image_only, is_font_corrupted, native_chars, native_quality of a page.

    First rule that holds: scanned or images alone; under 15 characters beside images; corrupt text or a quality under 0.6.
    counts: columns that hold quality_counts of the text.
    """
    text, scanned = F.coalesce(text, F.lit("")), F.coalesce(scanned, F.lit(False))
    q = text_quality(text, counts)
    only = scanned | ((spans == 0) & (images > 0))
    few = (F.length(text) < 15) & (images > 0)
    bad = q["is_corrupted"] | (q["quality_score"] < 0.60)

    def case(a, b, c, d):
        return F.when(only, a).when(few, b).when(bad, c).otherwise(d)

    n, score = F.length(text).cast("long"), q["quality_score"]
    return {"should_ocr": case(True, True, True, False), "necessity": case(1.0, 0.85, 0.90, 0.0), "is_image_only": only, "is_font_corrupted": case(False, False, True, False),
            "native_chars": case(F.lit(0).cast("long"), n, n, n), "native_quality": case(F.lit(0.0), F.lit(0.30), score, score)}


def decision(text: Column, spans: Column, images: Column, script: Column, script_confidence: Column, counts=None) -> dict[str, Column]:
    """kind (Require, Skip, Fuse), dpi, is_bilingual, arabic_chars, latin_chars, quality, ocr_weight of an Arabic page.

    script: the calligraphic script or null. First rule that holds: no spans; quality under 0.50 or over 10 private
    characters; calligraphy; a quality from 0.88 without private characters is skipped; what is left is fused."""
    text, calligraphic = F.coalesce(text, F.lit("")), script.isNotNull()
    q = text_quality(text, counts)
    arabic, latin = T.count(text, T.RTL), T.count(text, "A-Za-z")
    empty = spans == 0
    bad = (q["quality_score"] < 0.50) | (q["pua_chars"] > 10)
    drawn = calligraphic & ((images > 0) | (q["quality_score"] < 0.95) | (script_confidence >= 0.75))
    skip = (q["quality_score"] >= 0.88) & (q["pua_chars"] == 0)
    kind = F.when(empty | bad | drawn, "Require").when(skip, "Skip").otherwise("Fuse")
    quality = F.when(empty, 0.0).otherwise(q["quality_score"])
    return {"kind": kind, "dpi": F.when(empty | calligraphic, 300).otherwise(150), "is_bilingual": ~empty & (arabic > 0) & (latin > 0) & (latin / (arabic + latin) > 0.15),
            "arabic_chars": F.when(empty, 0).otherwise(arabic), "latin_chars": F.when(empty, 0).otherwise(latin), "quality": quality, "ocr_weight": F.when(kind == "Fuse", 1.0 - quality)}


# --- calligraphy


def script_by_font(font: Column) -> Column:
    """The calligraphic script that a font's name tells, or null."""
    low, out = F.lower(font), None
    for script, names in CALLIGRAPHY:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(low, F.lit(n))
        out = F.when(hit, script) if out is None else out.when(hit, script)
    return out


def glyph_metrics(spans: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, overlap_density, slope_ratio, mean_slope, deviation, confidence of the spans of a page (y, x, w, font_size)."""
    order = Window.partitionBy(*key).orderBy("span_idx")
    nx, ny, nw = (F.lead(c).over(order) for c in "xyw")
    dx, dy = F.greatest(F.abs(nx - F.col("x")), F.lit(1.0)), F.abs(ny - F.col("y"))
    overlap = (F.greatest("x", nx) < F.least(F.col("x") + F.col("w"), nx + nw)) & (dy > 1.5) & (dy < F.col("font_size") * 2)
    slope = dy / dx
    s = spans.withColumn("over_", overlap).withColumn("slope_", F.when(slope.between(0.10, 2.5) & (dy >= 1.5), slope))
    g = s.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if("over_").alias("o"), F.count("slope_").alias("d"), F.avg("slope_").alias("m"), F.stddev_pop("y").alias("sd"))
    few, pairs = F.col("n") < 3, F.col("n") - 1
    zero = lambda c: F.when(few, 0.0).otherwise(c)
    g = g.select(*key, zero(F.col("o") / F.nullif(pairs, F.lit(0))).alias("overlap_density"), zero(F.col("d") / F.nullif(pairs, F.lit(0))).alias("slope_ratio"), zero(F.coalesce("m", F.lit(0.0))).alias("mean_slope"), zero(F.col("sd")).alias("deviation"))
    part = lambda c, full, weight: F.least(F.col(c) / full, F.lit(1.0)) * weight
    return g.withColumn("confidence", F.least(part("overlap_density", 0.25, 0.40) + part("slope_ratio", 0.30, 0.45) + part("deviation", 4.0, 0.15), F.lit(1.0)))


def calligraphy(spans: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, script (null: none), confidence, dpi of a page: the first span whose font tells a script, else the metrics."""
    named = spans.groupBy(*key).agg(F.min_by(script_by_font(F.col("font")), F.when(script_by_font(F.col("font")).isNotNull(), F.col("span_idx"))).alias("named"))
    m = glyph_metrics(spans, key).join(named, list(key))
    drawn = F.col("confidence") >= 0.75
    script = F.coalesce("named", F.when(drawn, F.when(F.col("slope_ratio") >= 0.35, "Nastaliq").otherwise("GenericCalligraphic")))
    confidence = F.when(F.col("named").isNotNull(), 0.95).when(drawn, F.col("confidence")).otherwise(1.0 - F.col("confidence"))
    return m.select(*key, script.alias("script"), confidence.alias("confidence"), F.when(script.isNotNull(), 300).otherwise(150).alias("dpi"))


# --- two texts


def best_stream(native: Column, quality: Column, recognised: Column, confidence: Column) -> dict[str, Column]:
    """text, confidence and source: native from a quality of 0.85 on, else what is surer; ties go to native."""
    pick = (quality < 0.85) & (confidence > quality)
    return {"text": F.when(pick, recognised).otherwise(native), "confidence": F.when(pick, confidence).otherwise(quality), "source": F.when(pick, "ocr").otherwise("native")}


def fuse(native: Column, recognised: Column, quality: Column, confidence: Column) -> Column:
    """struct(text, confidence, native_chars, ocr_chars, source): both texts sign by sign, after six early exits. A broken
    native sign gives way, a broken recognised one never wins, else the surer text does; native on ties."""
    a, b = F.coalesce(native, F.lit("")), F.coalesce(recognised, F.lit(""))
    ta, tb, na, nb = T.strip(a), T.strip(b), F.length(a), F.length(b)
    broken = T.count(a, CORRUPT)
    every = lambda x: F.filter(F.split(x, ""), lambda ch: ch != "")
    bad = lambda ch: ch.rlike(f"[{CORRUPT}]")

    def sign(c, own):
        return F.struct(c.alias("c"), F.lit(own).alias("n"))

    def pick(x, y):
        both = F.when(x == y, sign(x, True)).when(bad(x), sign(y, False)).when((y == "�") | (quality >= confidence), sign(x, True)).otherwise(sign(y, False))
        left = F.when(~bad(x), sign(x, True))
        right = F.when(y != "�", sign(y, False))
        return F.when(x.isNotNull() & y.isNotNull(), both).when(x.isNotNull(), left).when(y.isNotNull(), right)

    signs = F.filter(F.zip_with(every(a), every(b), pick), lambda s: s.isNotNull())

    def merged(s):
        text = F.array_join(F.transform(s, lambda x: x["c"]), "")
        n = F.size(F.filter(s, lambda x: x["n"]))
        o = F.size(s) - n
        mean = (quality * n + confidence * o) / F.greatest(F.size(s), F.lit(1))
        repaired = F.when((broken > 0) & (T.count(text, CORRUPT) == 0), 0.15).otherwise(0.0)
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(mean + repaired, F.greatest(quality, confidence))))
        return out(text, sure, n, o, "fused")

    def out(text, conf, n, o, source):
        return F.struct(text.alias("text"), conf.cast("double").alias("confidence"), n.cast("long").alias("native_chars"), o.cast("long").alias("ocr_chars"), F.lit(source).alias("source"))

    zero = F.lit(0)
    fused = F.transform(F.array(signs), merged)[0]  # the signs are made once
    return (F.when((ta == "") & (tb == ""), out(F.lit(""), F.lit(1.0), zero, zero, "empty")).when(ta == "", out(b, confidence, zero, nb, "ocr")).when(tb == "", out(a, quality, na, zero, "native"))
            .when(ta == tb, out(a, F.greatest(quality, confidence), na, zero, "identical")).when((quality >= 0.92) & (broken == 0), out(a, quality, na, zero, "native"))
            .when(((quality < 0.20) | (broken / F.greatest(na, F.lit(1)) > 0.50)) & (confidence >= 0.85), out(b, confidence, zero, nb, "ocr")).otherwise(fused))
