"""Token counts of whole texts, as the tokenizers library gives them."""

import gc
import json
import os
import string
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import map_texts

#: characters of one chunk of a huge document, and of the first overlap that is tried
CHUNK, OVERLAP = 16_384, 256
#: word counts that one task remembers, and bytes of these words
_MEMO, _MEMO_BYTES = 600_000, 64 << 20
#: words that the tokenizer itself remembers; few of them cost more time than none
_CACHE = 100_000
#: a pattern that ends each run of ASCII letters, and each digit, where punctuation other than ``'`` follows
_RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPACE = " \t\n\r\x0b\x0c"


def separable(spec: dict) -> bool:
    """Whether words between ASCII white space are certain to be encoded independently of each other.

    So it is if the pre-tokenizer drops white space (it keeps matches of a pattern without it), each step of the
    normalizer looks at single characters, combining sequences or runs of white space, and no added token has white space
    or strips its neighbours.
    """
    steps = spec.get("normalizer") or {}
    steps = steps.get("normalizers", [steps] if steps else [])
    pre = spec.get("pre_tokenizer") or {}
    pre = pre.get("pretokenizers", [pre])
    first = pre[0] if pre else {}
    return (all(s.get("type") in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or
                (s.get("type") == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps)
            and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and not any(c.isspace() for c in first["pattern"].get("Regex", " "))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
                        for t in spec.get("added_tokens", [])))


def detachable(spec: dict) -> tuple[bytes, bool]:
    """(ASCII punctuation that is encoded independently of ASCII letters and digits before it, whether these may be lower-cased first).

    It is proven for the pattern ``_RUNS`` of a :func:`separable` file whose other pre-tokenizers cut nothing. The normalizers
    leave ASCII as it is, but for its case. No character of an added token is detached, and none is letters and digits only.
    """
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    added = "".join(t["content"] for t in spec.get("added_tokens", []))
    if not (separable(spec) and pre and pre[0]["pattern"] == {"Regex": _RUNS} and all(
            p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in pre[1:])
            and not any(t["content"].isalnum() for t in spec.get("added_tokens", []))):
        return b"", False
    steps = spec.get("normalizer") or {}
    lower = any(s.get("type") == "Lowercase" for s in steps.get("normalizers", [steps]))
    return "".join(c for c in string.punctuation if c != "'" and c not in added).encode(), lower


class TokenCounter:
    """Counts for one tokenizer file (.json); truncation and padding are off, no special tokens are added."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.independent = separable(spec)
        self.tails, self.lower = detachable(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(_CACHE)
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[bytes, int] = {}
        self.held = self.widened = 0

    def count(self, texts: list) -> list[int]:
        """Tokens of each text (UTF-8 bytes or None)."""
        whole = [t.decode("utf-8", "replace") if t and len(t) > self.chunk else None for t in texts]
        out = [self.spliced(w) if w is not None and len(w) > self.chunk else None for w in whole]
        short = [i for i, n in enumerate(out) if n is None]
        for i, n in zip(short, self._short([texts[i] or b"" for i in short])):
            out[i] = n
        return out

    def _short(self, texts: list[bytes]) -> list[int]:
        if not self.independent:
            return [len(e) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        split = [t.split() for t in texts]
        self._need(split)
        return [sum(map(self.memo.__getitem__, words)) for words in split]

    def _need(self, split: list[list[bytes]]) -> None:
        """See to it that the counts of all these words are known."""
        memo, words = self.memo, set().union(*split)
        new = words.difference(memo)
        self.held += sum(map(len, new))
        if len(memo) + len(new) > _MEMO or self.held > _MEMO_BYTES:
            memo.clear()
            new, self.held = words, sum(map(len, words))
        if not self.tails:
            self._learn(sorted(new))
            return
        memo[b""] = 0
        cut = []  # letters and digits, and the punctuation after them
        for w in new:
            stem = w.rstrip(self.tails)
            if stem.isalnum():  # of bytes: ASCII only
                cut.append((w, stem.lower() if self.lower else stem, w[len(stem):]))
        units = new.difference([w for w, _, _ in cut]).union([x for _, x, _ in cut], [x for _, _, x in cut]).difference(memo)
        self.held += sum(map(len, units.difference(new)))
        self._learn(sorted(units))
        memo.update([(w, memo[stem] + memo[tail]) for w, stem, tail in cut])

    def _learn(self, words: list[bytes]) -> None:
        """Counts of words, many of them in one text; a token belongs to the word in which it starts."""
        for k in range(0, len(words), 512):
            part = [w.decode("utf-8", "replace") for w in words[k:k + 512]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets
            begin = np.cumsum([0] + [len(w) + 1 for w in part])
            at = np.fromiter((a for a, _ in found), np.int64, len(found))
            tokens = np.bincount(np.searchsorted(begin, at, side="right") - 1, minlength=len(part))
            self.memo.update(zip(words[k:k + 512], tokens.tolist()))

    def _encoded(self, text: str, start: int, stop: int):
        """The first character in the document of a chunk and its encoding; offsets are asked for where they are needed."""
        return start, self.tokenizer.encode(text[start:stop], add_special_tokens=False)

    @staticmethod
    def _from(chunk, at: int) -> int:
        """How many tokens of a chunk start before a character of the document."""
        start, found = chunk
        return bisect_left(range(len(found)), at - start, key=lambda i: found.token_to_chars(i)[0])

    def _boundary(self, cuts: list[int], left, right) -> int | None:
        """The last of the places ``cuts`` in the overlap where both chunks may be cut, or None.

        A cut is the start of a run of ASCII white space that has text before it. No pre-token of the tokenizers in use
        reaches over such a place, so what is on one side has no influence on the other. The cut counts as proven if from
        the first such place in the overlap up to it both chunks hold the same units at the same offsets; before the first
        one, the right chunk may have begun inside a word.
        """
        if len(cuts) < 2:
            return None
        low, high = cuts[0], cuts[-1]
        views = []
        for chunk in (left, right):
            start, found = chunk
            units = [(a + start, b + start) for a, b in map(found.token_to_chars, range(self._from(chunk, low), self._from(chunk, high)))]
            if not units or units[-1][1] > high:
                return None
            views.append(units)
        return high if views[0] == views[1] else None

    def spliced(self, text: str) -> int:
        """Tokens of a huge text: overlapping chunks are encoded with offsets and spliced at proven common boundaries.

        Where chunks do not align, the overlap is doubled. It may grow to the last splice; then the chunk itself
        doubles, at the end to the whole rest of the text, so a run without a place to cut is encoded a few times its length. Memory is
        that of the chunk.
        """
        n, cut, total, size = len(text), 0, 0, self.chunk
        stop = min(n, self.chunk)
        left = self._encoded(text, 0, stop)
        while stop < n:
            overlap = self.overlap
            while True:
                begin = max(cut, stop - overlap)
                cuts = [p for p in range(begin + 1, stop) if text[p] in _SPACE and text[p - 1] not in _SPACE]
                if len(cuts) < 2 and begin > cut:  # nothing to align at: nothing to encode yet
                    self.widened += 1
                    overlap *= 2
                    continue
                end = min(n, max(begin, stop) + size - self.overlap)
                right = self._encoded(text, begin, end)
                at = self._boundary(cuts, left, right)
                if at is not None:
                    total += self._from(left, at) - self._from(left, cut)
                    cut, left, stop, size = at, right, end, self.chunk
                    break
                self.widened += 1
                if begin == cut:  # no place to cut since the last splice: one longer chunk
                    left, stop, size = right, end, 2 * size
                    break
                overlap *= 2
        return total + len(left[1]) - self._from(left, cut)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of whole texts, for a tokenizer file that every executor has.

    The counts are those of the library on the whole text: no tokens added, strings of special tokens handled as its
    default, no truncation. NULL and empty texts have 0 bytes and 0 tokens; rows that repeat a doc_id, or have none, are
    counted one by one; other columns are not read. An empty table gives an empty one. A text longer than ``chunk``
    characters is encoded in overlapping chunks, spliced by the offsets of their tokens. Shorter ones are one chunk; if the tokenizer is
    :func:`separable`, equal words of a task's short texts are encoded once. Bytes that are no UTF-8 count as U+FFFD.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    held: list[TokenCounter] = []

    def run(ids, texts):
        if not held:
            gc.collect()  # of the tasks that this worker ran before
            held.append(TokenCounter(path, chunk, overlap))
        counts = held[0].count(texts)
        return {"doc_id": ids, "n_bytes": [len(t or b"") for t in texts], "n_tokens": counts,
                "over_limit": [c > limit for c in counts]}

    return map_texts(docs, "doc_id", "text", run, schema)
