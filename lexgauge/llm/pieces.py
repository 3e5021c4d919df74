"""Token ids of whole texts, looked up by piece.

A tokenizer that drops white space and cuts words before it merges gives a text
the ids of its pieces in order.  Texts of characters up to U+00FF are cut with
numpy, many at a time, and their pieces are looked up in a hash table of exact
keys, the piece's bytes; only pieces that are not in it go to the tokenizer.
Other texts are cut one by one.  A tokenizer that is built otherwise encodes
whole texts.
"""

from __future__ import annotations

import json
import re
from unicodedata import category, is_normalized

import numpy as np

#: What a tokenizer file has to say of normalizing and cutting for its texts to be cut here (fixed values).
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: White space that such a tokenizer treats as one separator (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks the last token of a word in the vocabulary (fixed value).
WORD_END = "</w>"
#: Stands between pieces that are encoded together; it is a token of its own.
BREAK = "\0"
#: Pieces that are encoded together.
TOGETHER = 512
#: Bytes of a piece that fit its key; longer ones are kept by their text.
KEY = 16
#: Pieces that a new table has room for; it doubles when it is half full, so it is as large as what a worker has met.
ROOM = 1 << 14


class Pool:
    """Ids of all known pieces, one after the other."""

    def __init__(self) -> None:
        self.ids = np.zeros(1 << 16, "<u4")
        self.used = 0

    def add(self, ids: np.ndarray) -> int:
        begin, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")))
        self.ids[begin : self.used] = ids
        return begin


class PieceTable:
    """Open addressing over 16-byte keys, with all lookups of a batch at once."""

    def __init__(self, most: int) -> None:
        self.slots = 1 << max(4, (2 * most - 1).bit_length())
        self.first, self.second = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.begin, self.count = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        self.size = 0

    def _home(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not known."""
        found = np.full(len(first), -1, np.int64)
        slot, rows = self._home(first, second), np.arange(len(first))
        while len(rows):
            taken = self.begin[slot] >= 0
            same = taken & (self.first[slot] == first[rows]) & (self.second[slot] == second[rows])
            found[rows[same]] = slot[same]
            on = taken & ~same
            rows, slot = rows[on], (slot[on] + 1) & (self.slots - 1)
        return found

    def add(self, first: np.ndarray, second: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """Put in keys that are distinct and not known; the caller keeps the table at most half full."""
        self.size += len(first)
        slot, rows = self._home(first, second), np.arange(len(first))
        while len(rows):
            free = self.begin[slot] < 0
            # Of the keys that want a free slot, the first gets it.
            _, winner = np.unique(np.where(free, slot, self.slots + np.arange(len(slot))), return_index=True)
            won = np.zeros(len(rows), bool)
            won[winner] = free[winner]
            at, row = slot[won], rows[won]
            self.first[at], self.second[at] = first[row], second[row]
            self.begin[at], self.count[at] = begin[row], count[row]
            rows, slot = rows[~won], (slot[~won] + 1) & (self.slots - 1)


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Encoder:
    """Ids of texts by the tokenizer of a file; a worker keeps one with what it has learned.

    ``most`` pieces are known at a time; beyond that the encoder begins anew,
    so its memory is bounded whatever the texts.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        cutter = rules.get("pre_tokenizer") or {}
        steps = cutter.get("pretokenizers", [{}])
        self.cuts = (
            rules.get("normalizer") == _NORMALIZER
            and steps[0].get("pattern") == {"Regex": _SPLIT}
            and steps[0].get("behavior") == "Removed"
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and rules.get("post_processor") is None
            and rules["model"].get("end_of_word_suffix") == WORD_END
        )
        self.special = [token["content"] for token in rules.get("added_tokens", [])]
        self.most = most
        if not self.cuts:
            return
        letter = re.compile(r"[^\W\d_]")
        space = re.compile(f"[{SPACE}]")
        characters = [chr(k) for k in range(256)]
        #: 0 for white space, 1 for letters, 2 for all else, as ``_pieces`` cuts them.
        self.kind = np.array([0 if space.match(c) else 1 if letter.match(c) else 2 for c in characters], np.uint8)
        self.lower = bytes(ord(c.lower()) for c in characters)
        self.split = re.compile(f"[{SPACE}]+").split
        self.cut = re.compile(rf"[^\W\d_]+|(?:[^\w{SPACE}]|[\d_])+").findall
        self.word = re.compile("[a-zß-öø-ÿ]+").fullmatch
        vocabulary = self.tokenizer.get_vocab(True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True
        (self.mark,) = self._whole([BREAK])[0].tolist()
        self._clear()

    def _clear(self) -> None:
        self.pool, self.table = Pool(), PieceTable(min(self.most, ROOM))
        self.texts: dict[str, tuple[int, int]] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text, as the tokenizer gives them without special tokens added."""
        if not self.cuts:
            return self._whole(texts)
        if self.table.size + len(self.texts) > self.most:
            self._clear()
        out: list[np.ndarray | None] = [None] * len(texts)
        narrow: list[tuple[int, bytes]] = []
        for k, text in enumerate(texts):
            if any(token in text for token in self.special):
                (out[k],) = self._whole([text])
            elif "'" in text or BREAK in text:
                (out[k],) = self._by_text([text])
            else:
                try:
                    narrow.append((k, text.encode("latin-1")))
                except UnicodeEncodeError:
                    (out[k],) = self._by_text([text])
        if narrow:
            for (k, _), ids in zip(narrow, self._by_bytes([raw for _, raw in narrow])):
                out[k] = ids
        return out

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text of any characters, lower-cased and cut where the tokenizer surely cuts."""
        lowered = text.lower()
        # A capital sigma is lowered by its place in the word, and not so by the tokenizer.
        if "'" in text or "\u03a3" in text or not (is_normalized("NFC", text) and is_normalized("NFC", lowered)):
            return self.split(text)
        # What this Python does not know may be a letter to the tokenizer.
        if any(category(c) == "Cn" for c in set(text)):
            return self.split(text)
        return self.cut(lowered)

    def _by_text(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._pieces(text) for text in texts]
        new = sorted(set().union(*cut).difference(self.texts))
        begins, counts = self._learn(new)
        self.texts.update(zip(new, zip(begins.tolist(), counts.tolist())))
        out = []
        for pieces in cut:
            places = np.array([self.texts[p] for p in pieces], np.int64).reshape(-1, 2)
            out.append(self._gather(places[:, 0], places[:, 1]))
        return out

    def _gather(self, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids of pieces one after the other."""
        before = np.cumsum(count) - count
        return self.pool.ids[np.repeat(begin - before, count) + np.arange(int(count.sum()))]

    def _by_bytes(self, raws: list[bytes]) -> list[np.ndarray]:
        lowered = b" ".join(raws).translate(self.lower)
        data = np.frombuffer(lowered + b" " * KEY, np.uint8)
        kind = self.kind[data]
        bounds = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]))
        real = kind[bounds[:-1]] > 0
        start, end = bounds[:-1][real], bounds[1:][real]
        size = end - start
        # Eight bytes from every place on; what lies behind a piece is masked off.
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        first = eight[start] & _LOW_BYTES[np.minimum(size, 8)]
        second = eight[np.minimum(start + 8, len(eight) - 1)] & _LOW_BYTES[np.clip(size - 8, 0, 8)]
        short = size <= KEY
        slot = np.full(len(start), -1, np.int64)
        slot[short] = self.table.find(first[short], second[short])
        unknown = np.flatnonzero(short & (slot < 0))
        if len(unknown):
            order = unknown[np.lexsort((second[unknown], first[unknown]))]
            new = order[np.concatenate(([True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])))]
            line = lowered.decode("latin-1")
            learned = self._learn([line[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
            table = self.table
            self._make_room(len(new))
            self.table.add(first[new], second[new], *learned)
            # In a larger table the pieces that were known have moved, too.
            again = unknown if self.table is table else np.flatnonzero(short)
            slot[again] = self.table.find(first[again], second[again])
        begin, count = self.table.begin[slot], self.table.count[slot]
        for k in np.flatnonzero(~short).tolist():
            piece = lowered[start[k] : end[k]].decode("latin-1")
            if piece not in self.texts:
                where = self._learn([piece])
                self.texts[piece] = (int(where[0][0]), int(where[1][0]))
            begin[k], count[k] = self.texts[piece]
        ids = self._gather(begin, count)
        text_ends = np.cumsum([len(raw) + 1 for raw in raws])
        pieces_before = np.searchsorted(start, text_ends)
        cuts = np.concatenate(([0], np.cumsum(count)))[pieces_before]
        return np.split(ids, cuts[:-1]) if len(raws) > 1 else [ids]

    def _make_room(self, more: int) -> None:
        """Double the table while it would be more than half full."""
        while 2 * (self.table.size + more) > self.table.slots:
            old, self.table = self.table, PieceTable(self.table.slots)
            held = np.flatnonzero(old.begin >= 0)
            self.table.add(old.first[held], old.second[held], old.begin[held], old.count[held])

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces, many at a time; where their ids begin in the pool and how many they are.

        Words of plain letters end at tokens that say so; between other pieces
        stands a break.
        """
        begins, counts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        plain = [self.word(piece) is not None for piece in new]
        words = [k for k, is_word in enumerate(plain) if is_word]
        others = [k for k, is_word in enumerate(plain) if not is_word and BREAK not in new[k]]
        alone = [k for k, is_word in enumerate(plain) if not is_word and BREAK in new[k]]
        for rows, gap in ((words, " "), (others, f" {BREAK} ")):
            for at in range(0, len(rows), TOGETHER):
                part = rows[at : at + TOGETHER]
                (ids,) = self._whole([gap.join([new[k] for k in part])])
                if gap == " ":
                    stops = np.flatnonzero(self.ends[ids]) + 1
                    starts = np.concatenate(([0], stops[:-1]))
                else:
                    marks = np.flatnonzero(ids == self.mark)
                    starts, stops = np.concatenate(([0], marks + 1)), np.append(marks, len(ids))
                if len(starts) != len(part):
                    alone += part
                    continue
                begins[part], counts[part] = self.pool.add(ids) + starts, stops - starts
        for k in alone:
            (ids,) = self._whole([new[k]])
            begins[k], counts[k] = self.pool.add(ids), len(ids)
        return begins, counts
