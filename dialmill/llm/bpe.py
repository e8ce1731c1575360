"""BPE encoding through distinct-word tables, decoding through an id-to-piece join.

Spark splits every text at ASCII white space, which no token of the vocabulary spans. A task holds one table of the
distinct words of its texts: each is encoded once, and the texts' id sequences come from joining word positions with
that table. Decoding joins every id with the id-to-piece table, which has as many rows as the vocabulary and travels as a
literal in the plan, so it is a lookup by position in the JVM; digests are taken there too. The word tables stay with the
tasks: one for the whole corpus would have to send every occurrence of every word through a shuffle (see README), while
no text moves here.

The operator knows one family of tokenizers: lower-cased BPE with word-end marks, split at letters, digits and other
characters, without a decoder. A file with other rules raises.

Defined cases: null text is an empty text, with no tokens; texts are encoded whole, whatever their length; a table of
words is emptied when it would exceed TABLE_WORDS (it is refilled, results don't change); columns that clash with the
output names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialmill.llm.text import SPACE
from dialmill.runtime import bound_batches, tidy, without

TABLE_WORDS, SLICE_CHARS = 60_000, 1_200_000


#: A word that ends in marks after a Latin letter or digit is coded as its core and the marks: no token spans both. (U+0130
#: is left out, for its lower case ends in a combining mark.)
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F"
SPLIT = f"(?s)^(?P<core>.*[0-9{LETTERS}])(?P<tail>[.,!?;:]+)$"
PLAIN = f"^[{LETTERS}]+$"


def pieces(file: str) -> list[str]:
    """The piece of every id, in order of ids; a file whose rules this operator doesn't follow raises."""
    with open(file, encoding="utf-8") as f:
        rules = json.load(f)
    model, kinds = rules["model"], lambda part, names: [x["type"] for x in (rules[part] or {}).get(names, [])]
    splits = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    known = (
        model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("byte_fallback")
        and kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"] and rules.get("decoder") is None
        and splits.get("invert") and splits.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    )
    if not known:
        raise ValueError(f"{file}: not a lower-cased BPE with word-end marks and without a decoder")
    names = {i: p for p, i in model["vocab"].items()} | {x["id"]: x["content"] for x in rules["added_tokens"]}
    return [names.get(i, "") for i in range(max(names) + 1)]


def word_ends(file: str) -> np.ndarray:
    """For every id whether its piece ends a word."""
    return np.array([p.endswith("</w>") for p in pieces(file)])


class WordTable:
    """Distinct words and the bytes of their ids.

    Words that occur twice or more among the texts coded together stay in the table for the texts that follow.
    """

    def __init__(self, file: str, most: int = TABLE_WORDS, last: np.ndarray | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        self.last = word_ends(file) if last is None else last
        self.known: dict[str, bytes] = {}

    def encode(self, words: list[str], plain: bool) -> Iterator[bytes]:
        """The ids of distinct words, in order; many words are encoded in one text.

        A plain word, of letters only, ends where a token with the word-end mark does; elsewhere a token belongs to the
        word in which it starts.
        """
        for k in range(0, len(words), 1000):
            group = words[k : k + 1000]
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ids = np.array(e.ids, np.int32)
            cut = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1]) if plain else None
            if cut is None or len(cut) != len(group) + 1:
                starts = np.cumsum([0, *(len(w) + 1 for w in group)])
                owner = np.searchsorted(starts, [a for a, _ in e.offsets], "right") - 1
                cut = np.searchsorted(owner, np.arange(len(group) + 1))
            raw, cut = ids.tobytes(), (cut * 4).tolist()
            for a, b in zip(cut, cut[1:], strict=False):
                yield raw[a:b]

    def rows(self, words: pa.StringArray, occurs: np.ndarray) -> list[bytes]:
        """The ids of each distinct word; words that aren't known are encoded, each once."""
        known, names = self.known, words.to_pylist()
        out = [known.get(w) for w in names]
        new = np.array([r is None for r in out], bool)
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        for kind in (True, False):
            rows = np.flatnonzero(new & (plain == kind)).tolist()
            for i, row in zip(rows, self.encode([names[i] for i in rows], kind), strict=True):
                out[i] = row
        keep = np.flatnonzero(new & (occurs > 1)).tolist()
        if len(known) + len(keep) > self.most:
            known.clear()
        known.update((names[i], out[i]) for i in keep[: self.most])
        return out


def parted(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Core and tail of each word; the tail is null where the word isn't split. ASCII cores are lowered, as the vocabulary does."""
    both = pc.extract_regex(words, SPLIT)
    core = pc.coalesce(pc.struct_field(both, "core"), words)
    low = pc.and_(pc.string_is_ascii(core), pc.invert(pc.match_substring(core, "<")))
    return pc.if_else(low, pc.ascii_lower(core), core), pc.struct_field(both, "tail")


def encoder(file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    last = word_ends(file)  # once, in the driver: no task reads the file's rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(file, last=last)
        on = gc.isenabled()
        gc.disable()  # many small objects and no cycles: collection would cost more than the encoding
        try:
            for batch in batches:
                at = 0
                chars = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("__words")).to_numpy(zero_copy_only=False))]) * 6
                while at < batch.num_rows:  # bounded slices, one document at least
                    to = max(at + 1, int(np.searchsorted(chars, chars[at] + SLICE_CHARS, "right")) - 1)
                    yield coded(table, batch.slice(at, to - at))
                    at = to
        finally:
            if on:
                gc.enable()

    return run


def coded(table: WordTable, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The join of word positions with the table, document by document."""
    words = batch.column("__words")
    offsets = words.offsets.to_numpy()
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    core, tail = parted(flat.dictionary)
    halves = pa.concat_arrays([core, tail]).dictionary_encode()
    n = len(core)
    half = halves.indices.fill_null(-1).to_numpy().astype(np.int64)
    word = flat.indices.to_numpy()
    has_tail = (half[n:] >= 0)[word]
    place = np.cumsum(has_tail) - has_tail + np.arange(len(word))  # of each word's core among cores and tails
    at = np.empty(len(word) + int(has_tail.sum()), np.int64)
    at[place] = half[word]
    at[place[has_tail] + 1] = half[n:][word[has_tail]]
    rows = table.rows(halves.dictionary, np.bincount(at, minlength=len(halves.dictionary)))
    count = np.array([len(r) // 4 for r in rows], np.int64)
    first, every = np.cumsum(count) - count, np.frombuffer(b"".join(rows), np.int32)
    total = np.concatenate([[0], np.cumsum(count[at])])
    ids = every[np.repeat(first[at] - total[:-1], count[at]) + np.arange(total[-1])]
    ends = total[np.append(place, len(at))[offsets - offsets[0]]]
    keep = [i for i, name in enumerate(batch.schema.names) if name != "__words"]
    arrays = [batch.column(i) for i in keep] + [pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(ends.astype(np.int32), ids)]
    return pa.RecordBatch.from_arrays(arrays, [batch.schema.names[i] for i in keep] + ["n_tokens", "ids"])


def decoded(ids: Column, file: str) -> Column:
    """The text of ids: each joined with its piece, and pieces by a space, as this vocabulary has no decoder."""
    names = pieces(file)
    if any("\n" in p for p in names):
        raise ValueError(f"{file}: a piece holds a line end")
    table = F.split(F.lit("\n".join(names)), "\n")  # folded to a literal once
    return F.array_join(F.transform(ids, lambda i: F.get(table, i)), " ")


def encode(docs: DataFrame, file: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """docs' columns (or keep) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    bound_batches(docs.sparkSession)
    docs = docs if keep is None else docs.select(*dict.fromkeys([*keep, text_col]))
    own = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "__words"]
    kept = [c for c in without(docs, own).columns if keep is None or c in keep]
    split = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: w != "")
    src = docs.select(*kept, split.alias("__words"))
    schema = T.StructType([*src.select(*kept).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = src.mapInArrow(tidy(encoder(file)), schema)
    said = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return out.select(*kept, "n_tokens", said.alias("ids_sha256"), F.sha2(decoded(F.col("ids"), file), 256).alias("decoded_sha256"), *["ids"] * with_ids)
