"""Operator 3, BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a batch of texts lie one after another in one flat symbol array. A round looks up the rank of
every changed pair by binary search over the sorted pair keys, takes each word's lowest rank, and merges that pair
wherever it stands in the word. Words without a mergeable pair leave the array. Texts are then put together from the
ids of their words. The vocabulary is a public tokenizer file; nothing is trained.

Defined cases: a null text is empty; an empty text has no ids and decodes to the empty string; special tokens that
stand in a text become their ids, as in the tokenizers library; repeated rows are encoded row by row; extra columns
are left out; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, coded, table, text_slices

#: White space as the tokenizers' regular expressions have it.
_WS = r"\t-\r \x85\p{Z}"
_NONE = np.int32(np.iinfo(np.int32).max)
#: Stands between words that are split at once; texts that hold it are split alone.
_GAP = "\x00"
ENCODE_BYTES = 8 << 20
#: Distinct pre-tokens whose ids a worker remembers, at most but for one batch.
REMEMBERED = 400_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(rest)) for b in range(256)]


class BpeVocabulary:
    """A BPE vocabulary file of the tokenizers library with a byte-level alphabet.

    Two layouts are known: byte-level text with its spaces, and lower-cased words with an end-of-word suffix.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.word_layout = bool(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        chars = _byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        made = np.full(max(self.tokens) + 1, -1, np.int64)
        made[self.merged] = np.arange(len(pairs))
        at = np.arange(len(pairs))
        #: No merge needs a symbol that a later merge makes, and none is made twice: then all places of a word's lowest pair merge in one round.
        self.ordered = bool((made[left] < at).all() and (made[right] < at).all() and len(np.unique(self.merged)) == len(pairs))
        self._special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: What only units have that are looked at more closely: nothing at all, a special token's first character, or an unusual space.
        self._unusual = r"^$|[\x00\s\x0b\x{85}\pZ" + "".join(sorted({rf"\x{{{ord(t[0]):x}}}" for t in self.special})) + "]"
        tails = r"'s|'t|'re|'ve|'m|'ll|'d"
        if self.word_layout:
            self._token_re = regex.compile(rf"{_GAP}|{tails}|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}{_GAP}]+")
        else:
            self._token_re = regex.compile(rf"{_GAP}|{tails}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}{_GAP}]+|[{_WS}]+(?![^{_WS}{_GAP}])|[{_WS}]+")
        self._alone_re = regex.compile(self._token_re.pattern.replace(f"{_GAP}|", "", 1).replace(_GAP, ""))
        self._known, self._known_ids, self._known_counts = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
        byte_of = {c: b for b, c in enumerate(chars)}
        self._pieces: list[bytes] = [b""] * (max(self.tokens) + 1)
        for i, t in self.tokens.items():
            raw = t in self.special or self.word_layout
            self._pieces[i] = t.encode() if raw or any(c not in byte_of for c in t) else bytes(byte_of[c] for c in t)

    def _normal(self, text: str) -> str:
        """NFC and lower case, character by character (a capital sigma has one lower case)."""
        if not self.word_layout:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    # words to ids

    def merge_words(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as concatenated UTF-8 bytes, none empty: flat ids, and how many each word has."""
        n = len(lens)
        out, counts = np.empty(len(data), np.int32), np.zeros(n, np.int64)
        base = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        sym = self.first[data]
        if n:
            ends = base + lens - 1
            sym[ends] = self.last[data[ends]]
        word, starts, size = np.arange(n), base.copy(), lens.astype(np.int64)
        rank = self._ranks(sym, np.arange(len(sym)), starts, size)
        while len(word):
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                w = word[done]
                counts[w] = size[done]
                mask = np.repeat(done, size)
                out[np.repeat(base[w], size[done]) + _within(size[done])] = sym[mask]
                sym, rank = sym[~mask], rank[~mask]
                word, size, best = word[~done], size[~done], best[~done]
                starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(word) else starts[:0]
                if not len(word):
                    break
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            if self.ordered:
                run = np.concatenate([[True], at[1:] != at[:-1] + 1])  # a pair of equal symbols overlaps itself: every second place of a run
                first = np.maximum.accumulate(np.where(run, at, 0))
                at = at[(at - first) % 2 == 0]
            else:
                owner = np.searchsorted(starts, at, side="right")
                at = at[np.concatenate([[True], owner[1:] != owner[:-1]])]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            lost = np.add.reduceat((~keep).astype(np.int64), starts)
            moved = at - np.arange(len(at))  # places after the merged symbols have gone
            sym, rank = sym[keep], rank[keep]
            size = size - lost
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            touched = np.zeros(len(sym), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            change = np.flatnonzero(touched)
            rank[change] = self._ranks(sym, change, starts, size)
        kept = np.repeat(base, counts) + _within(counts)
        return out[kept], counts

    def _ranks(self, sym: np.ndarray, at: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; none at a word's last symbol."""
        last = np.zeros(len(sym) + 1, bool)
        last[starts + size - 1] = True
        out = np.full(len(at), _NONE, np.int32)
        open_ = np.flatnonzero(~last[at])
        place = at[open_]
        keys = (sym[place].astype(np.int64) << 32) | sym[place + 1]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        good = self.keys[found] == keys
        out[open_[good]] = self.ranks[found[good]]
        return out

    def _encode_distinct(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = tokens.cast(pa.large_binary())
        off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(raw) else np.zeros(0, np.uint8)
        return self.merge_words(data, np.diff(off))

    def _encode_tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens: flat ids, and how many each has. The last batches' distinct pre-tokens are remembered."""
        code, distinct = coded(tokens)
        if len(distinct) < 1000:
            return _gather(*self._encode_distinct(distinct), code)
        place = pc.index_in(distinct, value_set=self._known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        fresh = distinct.filter(pa.array(new))
        ids, counts = self._encode_distinct(fresh)
        ids, counts = np.concatenate([self._known_ids, ids]), np.concatenate([self._known_counts, counts])
        at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[new] = len(self._known) + np.arange(len(fresh))
        if len(counts) <= REMEMBERED:
            self._known, self._known_ids, self._known_counts = pa.concat_arrays([self._known, fresh]), ids, counts
        else:  # begin again with this batch's
            self._known = distinct
            self._known_ids, self._known_counts = _gather(ids, counts, at)
        return _gather(ids, counts, at[code])

    def _encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units of text, whose splitting does not depend on what stands around them."""
        if not len(units):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        plain, rest = units.slice(0, 0), units
        one, more = np.zeros(0, np.int64), np.arange(len(units))
        if not self.word_layout:  # letters with or without a space are one pre-token: nothing to split
            simple = pc.match_substring_regex(units, r"^ ?\pL+$").to_numpy(zero_copy_only=False)
            one, more = np.flatnonzero(simple), np.flatnonzero(~simple)
            plain, rest = units.take(pa.array(one)), units.take(pa.array(more))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), pa.scalar(_GAP, pa.large_string()))[0].as_py()
        tokens = pa.array(self._token_re.findall(self._normal(joined)) if len(rest) else [], pa.large_string())
        gap = pc.equal(tokens, _GAP).to_numpy(zero_copy_only=False)
        unit = np.cumsum(gap)[~gap]
        ids, counts = self._encode_tokens(pa.concat_arrays([plain, tokens.filter(pa.array(~gap))]))
        counts = np.concatenate([counts[: len(one)], np.bincount(unit, counts[len(one) :], len(more)).astype(np.int64)])
        at = np.empty(len(units), np.int64)
        at[np.concatenate([one, more])] = np.arange(len(units))
        return _gather(ids, counts, at)

    def _encode_alone(self, text: str) -> np.ndarray:
        """Ids of one text with special tokens or unusual spaces."""
        out = []
        for k, part in enumerate(self._special_re.split(text) if self._special_re else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], np.int32))
            elif part:
                tokens = self._alone_re.findall(self._normal(part))
                out.append(self._encode_tokens(pa.array(tokens, pa.large_string()))[0])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a large_string array without nulls: flat int32 ids, and n + 1 offsets."""
        n = len(text)
        lists = pc.ascii_split_whitespace(text) if self.word_layout else pc.split_pattern(text, " ")
        units, offsets = lists.flatten(), lists.offsets.to_numpy()
        row = np.repeat(np.arange(n), np.diff(offsets))
        code, distinct = coded(units)
        # few units have what may be a special token or an unusual space
        some = pc.match_substring_regex(distinct, self._unusual).to_numpy(zero_copy_only=False)
        at, seen = np.flatnonzero(some), distinct.filter(pa.array(some))

        def of(found: pa.Array) -> np.ndarray:
            """What holds of a unit, by what holds of the distinct texts that were seen."""
            flag = np.zeros(len(distinct), bool)
            flag[at] = found.to_numpy(zero_copy_only=False)
            return flag[code]

        special = pc.match_substring(seen, _GAP)
        for t in self.special:
            special = pc.or_(special, pc.match_substring(seen, t))
        strange = of(special)
        if not self.word_layout:
            # a space before a word belongs to it; where white space meets other white space the text goes alone
            first, last = np.zeros(len(code), bool), np.zeros(len(code), bool)
            first[offsets[:-1][np.diff(offsets) > 0]] = True
            last[offsets[1:][np.diff(offsets) > 0] - 1] = True
            strange |= of(pc.equal(pc.binary_length(seen), 0)) & ~first & ~last
            strange |= of(pc.match_substring_regex(seen, r"^[\s\x0b\x{85}\pZ]")) & ~first
            strange |= of(pc.match_substring_regex(seen, r"[\s\x0b\x{85}\pZ]$")) & ~last
        odd = np.bincount(row[strange], minlength=n) > 0
        if not self.word_layout:  # a unit has its space before it, but for a text's first
            code = 2 * code
            code[1:] += row[1:] == row[:-1]
        use = ~odd[row]
        there = np.zeros(2 * len(distinct) + 2, bool)
        there[code[use]] = True
        present = np.flatnonzero(there)
        if self.word_layout:
            wanted = distinct.take(pa.array(present))
        else:
            space = pa.array(["", " "], pa.large_string()).take(pa.array(present % 2))
            wanted = pc.binary_join_element_wise(space, distinct.take(pa.array(present // 2)), pa.scalar("", pa.large_string()))
        unit_ids, unit_counts = self._encode_units(wanted)
        slot = np.zeros(int(present[-1]) + 1 if len(present) else 0, np.int64)
        slot[present] = np.arange(len(present))
        ids, counts = _gather(unit_ids, unit_counts, slot[code[use]])
        size = np.bincount(row[use], counts, n).astype(np.int64)
        if odd.any():
            alone = {int(i): self._encode_alone(text[int(i)].as_py()) for i in np.flatnonzero(odd)}
            cut = np.concatenate([[0], np.cumsum(size)])
            ids = np.concatenate([alone[i] if i in alone else ids[cut[i] : cut[i + 1]] for i in range(n)])
            for i, x in alone.items():
                size[i] = len(x)
        return ids, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    # ids to text

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids, special tokens included, in UTF-8; ids outside the vocabulary are left out."""
        known = ids.tolist()
        pieces = self._pieces
        try:
            found = list(map(pieces.__getitem__, known))
        except IndexError:
            found = [pieces[i] for i in known if 0 <= i < len(pieces)]
        if self.word_layout:
            return b" ".join(found)
        text = b"".join(found)
        try:
            text.decode()
            return text
        except UnicodeDecodeError:
            return text.decode("utf-8", "replace").encode()


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gather(values: np.ndarray, counts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code, whose values lie together, and how many there are."""
    start = np.cumsum(counts) - counts
    size = counts[code]
    shift = start[code] - (np.cumsum(size) - size)
    return values[np.repeat(shift, size) + np.arange(int(size.sum()))] if len(code) else values[:0], size


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BpeVocabulary:
    return BpeVocabulary(path)


def encode_rows(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in text_slices(batches, limit=ENCODE_BYTES):
            ids, off = bpe.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.LargeListArray.from_arrays(pa.array(off), pa.array(ids)).cast(pa.list_(pa.int32()))], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_rows(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every row's ids; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            texts = [bpe.decode_bytes(np.array(x or [], np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and sha256 digests of every row's ids and of the text that they decode to; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in text_slices(batches, limit=ENCODE_BYTES):
            ids, off = bpe.encode(b.column("text"))
            raw = ids.astype("<u4")
            of_ids = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(off[:-1], off[1:], strict=True)]
            of_text = [hashlib.sha256(bpe.decode_bytes(raw[i:j])).hexdigest() for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


QUERIES = {"op3_bpe_merge_rounds": op3_bpe_merge_rounds}
