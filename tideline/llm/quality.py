"""Line-first quality rules: judge lines, drop those that fail, then reject documents that lose too much text.

A line fails for one of these reasons, in this order:

- boilerplate: a short line with a phrase of notices, licences or calls to act;
- symbols: three tenths of its words or more carry symbols such as # or &;
- navigation: two tenths of its words or more are separators such as | or >;
- shouting: most letters are capitals in a line of some length, or most words end in "!!";
- repetition: one word makes up over half of a line of eight words or more;
- unended: no word of it has closing punctuation although it is long enough to be a sentence.

A document is rejected if its lines keep less than MIN_KEPT of its word characters, or by the base rules (fewer than 10
words, or over a fifth of its words in repeated five-word windows). Lines without words are neither judged nor counted;
boilerplate is dropped but not counted as lost, as a notice says nothing against the text above it.
Null and empty texts have no words and fail the base rules. Rows are judged one by one, so repeated rows agree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import run_starts, slices
from tideline.llm.fingerprints import shingle_hashes

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MIN_KEPT = 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
SEPARATORS = frozenset("| > » · • / - – —".split())
BOILERPLATE = re.compile(
    "all rights reserved|licensed under|released under|terms of (?:use|service)|privacy policy|cookies?\\b|javascript|subscribe|newsletter"
    "|click here|read more|sign (?:in|up)|log ?in|follow us|share this|alle rechte vorbehalten|datenschutz|impressum"
    "|tous droits réservés|mentions légales|todos los derechos reservados|aviso legal",
    re.IGNORECASE,
)
BOILERPLATE_WORDS = 25
END = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*(?:\s|$)")
UNENDED_WORDS = 6


def line_fault(line: str) -> str | None:
    """Why a line fails; None if it stays."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    separators = sum(w in SEPARATORS for w in words)
    if n >= 4 and separators >= 0.2 * n:
        return "navigation"
    if SYMBOLS.search(line) and sum(1 for w in words if SYMBOLS.search(w)) >= 0.3 * n:
        return "symbols"
    if n >= 3 and (sum(w.endswith("!!") for w in words) > 0.5 * n or (line.upper() == line and line.lower() != line and len(line) >= 20)):
        return "shouting"
    if n >= 8 and Counter(words).most_common(1)[0][1] > 0.5 * n:
        return "repetition"
    if n >= UNENDED_WORDS and not END.search(line):
        return "unended"
    return None


def clean_lines(text: str) -> tuple[str, float, dict[str, int]]:
    """(the lines that stay, their share of the word characters outside boilerplate, lines lost by reason)."""
    lines = text.split("\n")
    faults = [line_fault(x) for x in lines]
    sizes = [sum(map(len, x.split())) for x in lines]
    kept = sum(s for s, f in zip(sizes, faults, strict=True) if f is None)
    judged = sum(s for s, f in zip(sizes, faults, strict=True) if f != "boilerplate")
    return "\n".join(x for x, f in zip(lines, faults, strict=True) if f is None), kept / max(1, judged), dict(Counter(f for f in faults if f))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = shingle_hashes(np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8"), window)
    order = np.argsort(hashes, kind="stable")
    starts = run_starts(hashes[order])
    counts = np.diff(np.append(starts, n))
    if counts.max() < 2:
        return 0
    repeated = np.zeros(n, dtype=bool)
    repeated[order] = np.repeat(counts > 1, counts)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    # all bytes but continuation bytes and ASCII white space
    chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_share double, clean_text string"


def judge_quality(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), with_text: bool = True, min_kept: float = MIN_KEPT) -> DataFrame:
    """The named columns of docs and MEASURES (clean_text is null without with_text)."""
    own = docs.select(*columns, F.col("text").alias("judged_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1]) + ", " + MEASURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text in batch.column("judged_text").to_pylist():
                text = text or ""
                measures = base_measures(text)
                failed = measures[0] < MIN_WORDS or 100 * measures[4] > MAX_REPEATED_PERCENT * measures[0]
                clean, share, _ = clean_lines(text)
                rows.append((*measures, failed, not failed and share >= min_kept, share, clean if with_text else None))
            values = [list(c) for c in zip(*rows, strict=True)]
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.string()]
            names = [x.split()[0] for x in MEASURES.split(", ")]
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v, t) for v, t in zip(values, types, strict=True)], [*batch.schema.names[:-1], *names])

    return own.mapInArrow(run, kinds)
