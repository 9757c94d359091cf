"""SentencePiece encoding and decoding of whole texts, with forward scores shared by common prefixes."""

import hashlib
import re
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import map_texts

_MARK = "▁"
#: encoded words that one task remembers, and their characters
_MEMO, _MEMO_CHARS = 300_000, 32 << 20
_NEVER = 1 << 60


class Pieces:
    """The vocabulary of a model file, and the encoding of single marked words.

    Two kinds of model are known. In a unigram model the forward score of a prefix is that of its best segmentation. In a BPE
    model each prefix has exactly one encoding, and its last piece is the one piece t that ends there and may follow the
    last piece of the prefix before t. Two pieces may follow each other if the merges of their joint text never join a
    part of the one with a part of the other. So both kinds have a forward pass over prefixes, and words with a common
    prefix share it. Scores that are the negative ranks 0, -1, -2, ... mark a BPE model.
    """

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.id = {self.piece[i]: i for i in range(size) if not special[i]}
        self.score = [model.get_score(i) for i in range(size)]
        normal = sorted((self.score[i] for i in self.id.values()), reverse=True)
        # pieces that no merge makes (single characters) may stand at the end in any order
        self.bpe = all(s == int(s) for s in normal)
        self.rank = {p: -self.score[i] for p, i in self.id.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not model.is_byte(i) for i in self.byte):
            self.byte = None
        self.unknown = model.unk_id()
        self.text = [b"" if special[i] else self.piece[i].replace(_MARK, " ").encode() for i in range(size)]
        if self.byte:
            for b, i in enumerate(self.byte):
                self.text[i] = bytes([b])
        if any(_MARK in p.lstrip(_MARK) for p in self.id):
            raise ValueError("pieces go on over a white-space mark: words cannot be encoded one by one")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id))  # these never join their neighbours
        self.alone = alone
        self.word = re.compile(f"[{alone}]|{_MARK}*[^{_MARK}{alone}]+|{_MARK}+" if alone else f"{_MARK}*[^{_MARK}]+|{_MARK}+")
        self.memo: dict[str, bytes] = {}
        self.root: dict | None = None
        self.lines: dict[int, tuple] = {}
        self.follows: dict[int, bool] = {}
        self.held = 0

    # --- BPE: which pieces may follow each other

    def _merges(self, text: str) -> list[tuple[float, str, str]]:
        """The merges of a text, best rank first and leftmost among equals: rank, then first and last symbol after it."""
        parts, out = list(text), []
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == _NEVER:
                break
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            out.append((best, parts[0], parts[-1]))
        return out

    def _line(self, i: int) -> tuple:
        """The ranks of the merges that make a piece, with its first and last symbol at each time."""
        line = self.lines.get(i)
        if line is None:
            text = self.piece[i]
            made = self._merges(text)
            line = self.lines[i] = ([m[0] for m in made] + [_NEVER], [text[0]] + [m[1] for m in made],
                                    [text[-1]] + [m[2] for m in made], not made and len(text) > 1 or bool(made) and made[-1][1] != text)
        return line

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the joint text of two pieces is encoded as just these two.

        The merges inside the two interleave by rank, left before right; the first merge across the border that is due
        before what both have left decides.
        """
        key = a * len(self.piece) + b
        known = self.follows.get(key)
        if known is None:
            ranks_a, _, ends, _ = self._line(a)
            ranks_b, starts, _, _ = self._line(b)
            x = y = 0
            rank = self.rank
            while True:
                across = rank.get(ends[x] + starts[y], _NEVER)
                left, right = ranks_a[x], ranks_b[y]
                if left <= across and left <= right:
                    if left == _NEVER:
                        known = True
                        break
                    x += 1
                elif across <= right:
                    known = False
                    break
                else:
                    y += 1
            self.follows[key] = known
        return known

    def _trie(self) -> dict:
        """The pieces as nested dicts by character, an id under None. In BPE only pieces that merges do make."""
        root: dict = {}
        for text, i in self.id.items():
            if self.bpe and self._line(i)[3]:
                continue
            node = root
            for c in text:
                node = node.setdefault(c, {})
            node[None] = i
        return root

    # --- forward pass over a trie of sorted words

    def encode_words(self, words: list[str]) -> None:
        """Encode distinct words into the memo: depth-first through the trie that they make when sorted.

        Along the way from the root each node keeps its forward entry: score, last piece (-1 for an unknown character) and
        its start, and the pieces begun before that may go on. A word only computes the nodes that it does not share
        with the one before.
        """
        bpe = self.bpe
        if self.root is None:
            self.root = self._trie()
        root = self.root
        score, piece, start, open_ = [0.0], [-2], [0], [[]]
        before = ""
        least = min(self.score) - 10.0
        own, follows, size, may_follow = self.score, self.follows, len(self.piece), self.may_follow
        for word in sorted(words):
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del piece[k + 1:], start[k + 1:], score[k + 1:], open_[k + 1:]
            for i in range(k, len(word)):
                c = word[i]
                got, at, best = -1, i, score[i] + least
                going = []
                for j, node in (*open_[i], (i, root)):  # longest first
                    node = node.get(c)
                    if node is None:
                        continue
                    going.append((j, node))
                    t = node.get(None)
                    if t is None:
                        continue
                    if not bpe:
                        s = score[j] + own[t]
                        if s > best:
                            got, at, best = t, j, s
                    elif got < 0:
                        p = piece[j]
                        if p >= 0:
                            ok = follows.get(p * size + t)
                            if not (may_follow(p, t) if ok is None else ok):
                                continue
                        got, at = t, j
                piece.append(got)
                start.append(at)
                score.append(best)
                open_.append(going)
            out, i = [], len(word)
            while i:
                p = piece[i]
                if p >= 0:
                    out.append(p)
                else:
                    out.extend(reversed(self._fallback(word[i - 1])))
                i = start[i]
            out.reverse()
            self.memo[word] = pack(f"<{len(out)}i", *out)
            before = word

    def _fallback(self, char: str) -> tuple:
        return tuple(self.byte[b] for b in char.encode()) if self.byte else (self.unknown,)

    def words(self, text: str) -> list[str]:
        """The marked words of a text; joined they are the text with each blank, and its begin, marked."""
        if not text:
            return []
        if "  " in text or _MARK in text or text[0] == " ":
            return self.word.findall(_MARK + text.replace(" ", _MARK))
        text = _MARK + text.replace(" ", " " + _MARK)
        for c in self.alone:
            if c in text:
                text = text.replace(c, f" {c} ")
        return text.split(" ")

    def encode(self, texts: list) -> list[bytes]:
        """Piece ids of each text (str) as little-endian 32-bit integers."""
        cut = [self.words(t) for t in texts]
        memo = self.memo
        new = {w for words in cut for w in words if w not in memo}
        self.held += sum(map(len, new))
        if len(memo) + len(new) > _MEMO or self.held > _MEMO_CHARS:
            memo.clear()
            new = {w for words in cut for w in words}
            self.held = sum(map(len, new))
        if len(self.follows) > 4 * _MEMO:
            self.follows.clear()
        self.encode_words(list(new))
        return [b"".join(map(memo.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        """Text of encoded ids as bytes; one leading blank is the mark that encoding has put there."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return text[1:] if text[:1] == b" " else text


def encoded(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, round_trip[, ids]) of whole texts, for a model file that every executor has.

    ``ids`` are those that the sentencepiece library gives without begin and end symbols; ``ids_sha256`` is the SHA-256
    of the ids as little-endian 32-bit integers. ``round_trip`` tells whether decoding gives the text back, each U+2581 in
    it as a blank. NULL and empty texts have no pieces and come back as empty. Rows that repeat a doc_id, or have none, are
    encoded one by one; other columns are not read. An empty table gives an empty one.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    held: list[Pieces] = []

    def run(ids, texts):
        if not held:
            held.append(Pieces(path))
        made = held[0].encode([t.decode("utf-8", "replace") if t else "" for t in texts])
        out = {"doc_id": ids, "n_pieces": [len(m) // 4 for m in made], "ids_sha256": [hashlib.sha256(m).hexdigest() for m in made],
               "round_trip": [held[0].decode(m) == (t or b"").replace(_MARK.encode(), b" ") for m, t in zip(made, texts)]}
        return out | ({"ids": [np.frombuffer(m, "<i4") for m in made]} if keep_ids else {})

    return map_texts(docs, "doc_id", "text", run, schema)
