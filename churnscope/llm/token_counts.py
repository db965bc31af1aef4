"""Token counts per document without token ids.

A text is cut into pre-tokens; the pieces of a pre-token are counted once per
distinct pre-token, joined to the document's pre-token frequencies, and the
products summed.  The join runs inside each task: its pre-token dictionary is
a bounded table (``HELD`` entries, then it starts anew), so nothing is
shuffled and a frequent pre-token is no hot key.

Supported vocabulary: a ``tokenizers`` JSON file whose pre-tokenizer is a
regular expression split (optionally followed by byte mapping), without ids
that span pre-tokens.  A text is first split at the vocabulary's added tokens,
of one token each.  A part with characters outside ``PLAIN`` goes through the
library's own normalizer and pre-tokenizer, in pieces cut at spaces, and its
pre-tokens through the same dictionary.  Another kind of vocabulary, or added
tokens that take in what is around them, leave the whole text to the library.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special
strings inside a text count as the library does by default; rows are never
merged; other columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
HELD = 300_000
#: characters, more or less, that the library splits at a time
PART = 1 << 16
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Characters for which lower() and NFC are the same here and in the library: printable ASCII, the usual white
#: space, and the precomposed letters of Latin-1.
PLAIN = r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*"
#: Fixed value: the pre-token pattern of the vocabulary word_bpe_49k.json.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class PieceCounter:
    """Counts the pieces of texts through a dictionary of pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        kinds = [spec["pre_tokenizer"]["type"], *[p["type"] for p in spec["pre_tokenizer"].get("pretokenizers", [])]]
        patterns = [p["pattern"].get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", []) if "pattern" in p]
        #: only this normalizer and pattern are known to equal the plain path
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.plain = kinds == ["Sequence", "Split", "ByteLevel"] and patterns == [
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"] and normal == ["NFC", "Replace", "Lowercase"]
        self.is_plain = re.compile(PLAIN).fullmatch
        self.words = regex.compile(WORDS).findall
        added = spec["added_tokens"]
        self.plain &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        # the longest of those that begin at one place
        special = sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)
        self.parts = re.compile("|".join(special)).split if special else lambda text: [text]
        self.known: dict[str | bytes, int] = {}

    def __call__(self, text: str) -> int:
        if not self.plain:
            return len(self.library.encode(text, add_special_tokens=False))
        parts = self.parts(text)
        return len(parts) - 1 + sum(map(self._part, parts))

    def _part(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if self.is_plain(text):
            return self._sum(Counter(self.words(text.lower())), lambda new: map(len, self.library.encode_batch(new, add_special_tokens=False)))
        frequency: Counter = Counter()
        at = 0
        while at < len(text):  # no pre-token holds or spans a space, and no character composes with one
            end = text.rfind(" ", at + 1, at + PART) if len(text) - at > PART else len(text)
            end = end if end > 0 else text.find(" ", at + PART)
            end = end if end > 0 else len(text)
            piece = self.library.normalizer.normalize_str(text[at:end])
            # as bytes, since the library spells them in byte characters
            frequency.update(w.encode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece))
            at = end
        return self._sum(frequency, lambda new: [len(self.library.model.tokenize(w.decode())) for w in new])

    def _sum(self, frequency: Counter, count: Callable) -> int:
        """Frequencies times tokens, joined through the dictionary."""
        known = self.known
        new = [w for w in frequency if w not in known]
        if new:
            if len(known) + len(new) > HELD:
                known.clear()
                new = list(frequency)
            for w, n in zip(new, count(new), strict=True):
                known[w] = n
        return sum(n * known[w] for w, n in frequency.items())


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter per Python worker and vocabulary."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; ``path`` names the vocabulary file on the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            texts = b.column(1)
            tokens = [count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                       ).mapInArrow(run, COUNTS)
