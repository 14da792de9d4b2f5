"""Audio columns: chroma fingerprints of clips, and alignment of clips by offset histograms and bit errors.

A clip's spectrum is folded onto the twelve pitch classes in overlapping frames. Filters that compare sums over
rectangles of this chroma image, taken from its integral image, each give two bits; sixteen filters pack into one
32-bit integer per frame. Clips that share integers at a common time offset are candidates, and at the best offsets of
the histogram the differing bits of all overlapping frames decide.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintfleet.llm.common import ship
from lintfleet.session import materialize

RATE = 2000
FRAME = 512
HOP = 128
PITCHES = 12
WIDTH = 12  # frames that the widest filter spans
LEVELS = (-0.25, 0.0, 0.25)  # of a filter's log ratio; between them the two bits change
MOST_ERRORS = 0.10  # share of differing bits of an aligned pair
LEAST_FRAMES = 20  # that must overlap
LEAST_VOTES = 2  # equal integers at one offset
OFFSETS = 3  # best offsets that are tried
BUCKET = 16384  # classes of the index whose hits on one query class are counted together
NOTES = 24  # of a rendered clip


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames) of the sixteen filters, by rule: four kinds, at four pitch ranges with growing width."""
    return [(kind, 3 * band, 4 + 2 * (kind % 3), (4, 6, 8, WIDTH)[(kind + band) % 4]) for kind in range(4) for band in range(4)]


def decode(audio: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in -1 .. 1 (channels averaged) and their rate; nothing for what is no 16-bit PCM wave."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as f:
            if f.getsampwidth() != 2:
                return np.empty(0, "f4"), RATE
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype("f4") / 32768
            return x.reshape(-1, f.getnchannels()).mean(axis=1), f.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0, "f4"), RATE


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12): energy by pitch class, each frame scaled to length 1."""
    if len(samples) < FRAME:
        return np.zeros((0, PITCHES), "f4")
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype("f4"), axis=1)).astype("f4") ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = hertz >= 55
    pitch = np.rint(PITCHES * np.log2(hertz[use] / 440)).astype(int) % PITCHES
    fold = np.zeros((use.sum(), PITCHES), "f4")
    fold[np.arange(use.sum()), pitch] = 1
    image = np.sqrt(power[:, use] @ fold)
    return image / np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-6)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each frame that the widest filter fits on. Pitch classes go round, so the image is repeated upwards."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, "u4")
    integral = np.zeros((len(image) + 1, 2 * PITCHES + 1))
    integral[1:, 1:] = np.concatenate([image, image], 1).cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t: int, frames: int, pitch: int, pitches: int) -> np.ndarray:
        a, b, c, d = at + t, at + t + frames, pitch, pitch + pitches
        return integral[b, d] - integral[a, d] - integral[b, c] + integral[a, c]

    codes = np.zeros(n, "u4")
    for k, (kind, pitch, high, wide) in enumerate(filters()):
        h, w = high // 2, wide // 2
        low_left, low_right = area(0, w, pitch, h), area(w, w, pitch, h)
        top_left, top_right = area(0, w, pitch + h, h), area(w, w, pitch + h, h)
        if kind == 0:  # early against late
            x, y = low_left + top_left, low_right + top_right
        elif kind == 1:  # low against high
            x, y = low_left + low_right, top_left + top_right
        elif kind == 2:  # the two diagonals
            x, y = low_left + top_right, low_right + top_left
        else:  # these pitches against those a tritone off
            x, y = area(0, wide, pitch, high), area(0, wide, (pitch + 6) % PITCHES, high)
        value = np.log((x + 0.05) / (y + 0.05))
        level = np.searchsorted(LEVELS, value).astype("u4")
        codes |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * k)  # neighbouring levels differ in one bit
    return codes


def fingerprints(clips: DataFrame, id_col: str = "clip_id", audio_col: str = "audio") -> DataFrame:
    """clip_id, codes (little-endian 32-bit integers). Null, empty, broken or too short audio has empty codes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(chroma(*decode(x.as_py()))).astype("<u4").tobytes() for x in batch], pa.binary())

    return clips.select(F.col(id_col).alias("clip_id"), F.arrow_udf(run, "binary")(F.col(audio_col)).alias("codes"))


def errors_at(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(differing bits, compared bits) of two code lists when place i of a meets place i + offset of b."""
    first = max(0, -offset)
    frames = min(len(a), len(b) - offset) - first
    if frames <= 0:
        return 0, 0
    return int(np.bitwise_count(a[first : first + frames] ^ b[first + offset : first + offset + frames]).sum()), 32 * frames


def best_offsets(votes: pa.Table) -> pa.Table:
    """The offset histograms of one query class and one bucket of the index: per other class the offsets with most votes."""
    votes = votes.combine_chunks()
    found = votes["found"].combine_chunks()
    hits = found.flatten()
    c = hits.field("c").to_numpy(zero_copy_only=False)
    offset = hits.field("c_place").to_numpy() - np.repeat(votes["q_place"].to_numpy(), found.value_lengths().to_numpy())
    other = c != votes["q"][0].as_py()
    classes, place = np.unique(c[other], return_inverse=True)
    low, span = offset.min(), np.ptp(offset) + 1
    cell, n = np.unique(place * span + (offset[other] - low), return_counts=True)  # class and offset as one number
    c, offset = classes[cell // span], cell % span + low
    c, offset, n = (x[n >= LEAST_VOTES] for x in (c, offset, n))
    order = np.lexsort((offset, np.abs(offset), -n, c))
    c, offset = c[order], offset[order]
    first = np.flatnonzero(np.diff(c, prepend=c[:1] - 1)) if len(c) else np.empty(0, "i8")
    sizes = np.diff(first, append=len(c))
    offsets = [offset[at : at + min(k, OFFSETS)].tolist() for at, k in zip(first.tolist(), sizes.tolist(), strict=True)]
    id_type = votes.schema.field("q").type
    return pa.table({"q": pa.repeat(votes["q"][0], len(first)), "c": pa.array(c[first], id_type), "offsets": pa.array(offsets, pa.list_(pa.int32()))})


def best_alignment(a: bytes, b: bytes, offsets: list[int]) -> dict | None:
    """Of the offsets at which enough frames overlap and few enough bits differ, the one with the smallest share of them."""
    tried = [(o, *errors_at(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), o)) for o in offsets]
    alike = [(errors / bits, -bits, o, errors) for o, errors, bits in tried if bits >= 32 * LEAST_FRAMES and errors <= MOST_ERRORS * bits]
    if not alike:
        return None
    _, less, offset, errors = min(alike)
    return {"offset": offset, "errors": errors, "bits": -less}


def align_clips(clips: DataFrame, every: int = 20, id_col: str = "clip_id", audio_col: str = "audio") -> DataFrame:
    """Which clips a query clip sounds like. Queries are all clips whose id is divisible by `every`, searched among all clips.

    Clips with equal fingerprints are one class, named by its smallest id. One row per query clip and matching class, its own
    class always among them: query_id, class_id (of the query), match_class, n_clips (in that class), frame_offset,
    bit_errors, bits. A clip without fingerprint is a class by itself and matches nothing else. Ids are integers; null ids are left out;
    repeated rows count in n_clips and give repeated query rows. Other columns are not read.
    """
    prints = materialize(fingerprints(clips.filter(F.col(id_col).isNotNull()), id_col, audio_col), "fingerprints")
    sounding = F.length("codes") > 0
    classes = prints.filter(sounding).groupBy("codes").agg(F.min("clip_id").alias("class_id"), F.count("*").alias("n_clips"),
                                                           F.max((F.pmod("clip_id", F.lit(every)) == 0).cast("int")).alias("asked"))
    classes = materialize(classes, "classes")
    asked = classes.filter("asked = 1")

    # (place, integer) of each frame: the index holds every clip, in buckets of a bounded number of classes
    def frames(df: DataFrame, side: str) -> DataFrame:
        places = F.sequence(F.lit(0), F.length("codes").cast("int") - 1, F.lit(4))
        coded = F.transform(places, lambda p: F.struct((p / 4).cast("int").alias("place"), F.substring("codes", p + 1, F.lit(4)).alias("code")))
        return df.select(F.col("class_id").alias(side), F.explode(coded).alias("f")).select(side, F.col("f.place").alias(f"{side}_place"), "f.code")

    buckets = -(-classes.count() // BUCKET)
    bucket = F.pmod(F.xxhash64("c"), F.lit(max(1, buckets))).cast("int")
    index = frames(classes, "c").groupBy("code", bucket.alias("bucket")).agg(F.collect_list(F.struct("c", "c_place")).alias("found"))
    id_type = classes.schema["class_id"].dataType.simpleString()
    votes = frames(asked, "q").join(index, "code").select("q", "bucket", "q_place", "found")
    tried = votes.groupBy("q", "bucket").applyInArrow(best_offsets, f"q {id_type}, c {id_type}, offsets array<int>")
    tried = tried.join(asked.select(F.col("class_id").alias("q"), F.col("codes").alias("_a")), "q")
    tried = tried.join(classes.select(F.col("class_id").alias("c"), F.col("codes").alias("_b"), "n_clips"), "c")

    def compare(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shape = pa.struct([("offset", pa.int32()), ("errors", pa.int64()), ("bits", pa.int64())])
        for batch in batches:
            yield pa.array([best_alignment(*row) for row in zip(*(x.to_pylist() for x in batch), strict=True)], shape)

    compared = tried.withColumn("m", F.arrow_udf(compare, "offset int, errors bigint, bits bigint")("_a", "_b", "offsets"))
    matches = compared.filter("m is not null").select(F.col("q").alias("class_id"), F.col("c").alias("match_class"), "n_clips", F.col("m.offset").alias("frame_offset"),
                                                      F.col("m.errors").alias("bit_errors"), F.col("m.bits").alias("bits"))
    itself = asked.select("class_id", F.col("class_id").alias("match_class"), "n_clips", F.lit(0).alias("frame_offset"), F.lit(0).cast("long").alias("bit_errors"),
                          (8 * F.length("codes")).cast("long").alias("bits"))
    queries = prints.filter(F.pmod("clip_id", F.lit(every)) == 0)
    named = queries.filter(sounding).join(classes.select("codes", "class_id"), "codes").select(F.col("clip_id").alias("query_id"), "class_id")
    found = named.join(itself.unionByName(matches), "class_id")
    silent = queries.filter(~sounding).select(F.col("clip_id").alias("query_id"), F.col("clip_id").alias("class_id"), F.col("clip_id").alias("match_class"),
                                              F.lit(1).cast("long").alias("n_clips"), F.lit(0).alias("frame_offset"), F.lit(0).cast("long").alias("bit_errors"), F.lit(0).cast("long").alias("bits"))
    columns = ["query_id", "class_id", "match_class", "n_clips", "frame_offset", "bit_errors", "bits"]
    return found.select(*columns).unionByName(silent.select(*columns))


def render(vector: list[float] | None) -> bytes | None:
    """A vector as a wave: each note sounds the twelve pitches as loud as the next twelve values say (the vector goes round)."""
    values = np.array([x for x in vector or () if x is not None and np.isfinite(x)], "f4")
    if not len(values):
        return None
    values = values / max(float(np.abs(values).max()), 1e-9)
    loud = np.exp(3 * values[(np.arange(NOTES)[:, None] * 5 + np.arange(PITCHES)[None, :]) % len(values)])
    samples = (loud / loud.sum(1, keepdims=True)) @ _tones()
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((samples.ravel() * 30000).astype("<i2").tobytes())
    return out.getvalue()


def _tones() -> np.ndarray:
    """(12, FRAME): the octave from A3 up."""
    return np.sin(2 * np.pi * 220 * 2 ** (np.arange(PITCHES)[:, None] / PITCHES) * np.arange(FRAME)[None, :] / RATE).astype("f4")


def clips_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """clip_id, audio: the tables have no media column, so each vector is rendered as a clip. Equal vectors sound equal, near ones alike."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([render(v) for v in batch.to_pylist()], pa.binary())

    return vectors.select(F.col(id_col).alias("clip_id"), F.arrow_udf(run, "binary")(F.col(vector_col)).alias("audio"))
