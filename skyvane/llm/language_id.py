"""Language of a text: known words first, then shorter and shorter character n-grams.

The model is a naive Bayes classifier over words. A known word adds its log frequency in each
language. An unseen word falls back on the longest character n-grams of it that any language
knows, and adds their mean log frequency.

The model is fitted on a bounded sample: of every language at most ``per_language`` labelled
documents, those with the smallest hash of their id, and fewer of each where all languages
together would have more than ``MOST_DOCUMENTS``. Every word and n-gram of the sample is kept.
The model holds them as sorted 64-bit hashes, with a log frequency for each language that has
them; the other languages share one value, so its size follows the sample and not the product
of words and languages. Texts are judged in blocks of ``_PART`` characters, in which each distinct
word is looked up once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from skyvane.llm import words
from skyvane.llm.storage import stored

PER_LANGUAGE = 3000
MOST_DOCUMENTS = 600_000
LONGEST_GRAM = 5
# Words of evidence that a score may rest on; more words do not make it surer.
EVIDENCE_WORDS = 20
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTER = re.compile(r"[\W\d_]")
_SMALLEST = 0.5
# Characters of text and sums that are laid out at once.
_PART = 1 << 18
_CELLS = 1 << 18


class Places:
    """Rows of items by the sorted hashes of all items."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def rows(self, items: list[str]) -> np.ndarray:
        """The row of each item, or -1."""
        return self.rows_of(hashes(items))

    def rows_of(self, code: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.codes):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)

    def __getitem__(self, item: str) -> int:
        row = int(self.rows([item])[0])
        if row < 0:
            raise KeyError(item)
        return row


class Logs:
    """Log frequencies by language of each row; ``absent`` has those of items not seen."""

    def __init__(self, first: np.ndarray, lang: np.ndarray, more: np.ndarray, absent: np.ndarray):
        self.first, self.lang, self.more, self.absent = first, lang, more, absent

    def __getitem__(self, rows) -> np.ndarray:
        return self.summed(rows, np.arange(len(rows)), np.ones(len(rows)), len(rows))

    def summed(self, rows, into: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """``n`` sums, one line each, of the rows ``times`` their factors."""
        weights = np.bincount(into, times, n)
        return self._above_absent(rows, into, times, n) + weights[:, None] * self.absent

    def means(self, rows, into: np.ndarray, n: int) -> Logs:
        """``n`` rows, the means of these ones."""
        share = 1 / np.maximum(np.bincount(into, minlength=n), 1)
        more = self._above_absent(rows, into, share[into], n).ravel()
        at = np.flatnonzero(more)
        size = len(self.absent)
        return Logs(np.searchsorted(at, np.arange(n + 1) * size), at % size, more[at], self.absent)

    def _above_absent(self, rows, into: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        rows = np.asarray(rows, dtype=np.int64)
        ends = np.cumsum(self.first[rows + 1] - self.first[rows])
        sums = np.zeros(n * len(self.absent))
        done, total = 0, 0
        # So many entries at a time, or those of one row, bound what is laid out.
        while done < len(rows):
            upto = max(int(np.searchsorted(ends, total + _CELLS, side="right")), done + 1)
            part = slice(done, upto)
            own, at = _laid_out(self.first[rows[part]], np.diff(ends[part], prepend=total))
            cell = into[part][own] * len(self.absent) + self.lang[at]
            sums += np.bincount(cell, times[part][own] * self.more[at], len(sums))
            done, total = upto, int(ends[upto - 1])
        return sums.reshape(n, -1)


def _laid_out(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``sizes`` places from ``first`` on: for each place the number of its run, and it."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    return own, np.arange(len(own)) + (first - np.cumsum(sizes) + sizes)[own]


def hashes(items: list[str]) -> np.ndarray:
    raw = [item.encode("utf-8", "surrogatepass") for item in items]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(raw)]
    return words.word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), starts, ends)


class LanguageModel:
    """``words`` and ``grams`` lead to rows of their log frequencies by language.

    ``of_words`` and ``of_grams`` are the arrays of ``_table``.
    """

    def __init__(
        self, languages: list[str], prior: np.ndarray, of_words: dict, of_grams: dict, longest: int
    ):
        self.plain = {
            "languages": languages,
            "prior": prior,
            "of_words": of_words,
            "of_grams": of_grams,
            "longest": longest,
        }
        self.languages, self.prior, self.longest = languages, prior, longest
        self.words, self.grams = Places(of_words["codes"]), Places(of_grams["codes"])
        self.word_logs, self.gram_logs = (
            Logs(*(own[k] for k in ("first", "lang", "more", "absent")))
            for own in (of_words, of_grams)
        )

    def unseen(self, word: str) -> np.ndarray:
        data = np.frombuffer(word.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        logs, any_known = self.all_unseen(data, np.array([0]), np.array([len(data)]))
        return logs.summed([0], np.array([0]), any_known.astype(float), 1)[0]

    def all_unseen(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[Logs, np.ndarray]:
        """A row for each word, the mean over its longest pieces that are known, and whether it
        has any. Words are given by where they start and end in the bytes ``data``."""
        lengths = ends - starts + 2
        after = np.cumsum(lengths)
        padded = np.full(after[-1], ord(">"), dtype=np.uint8)
        padded[after - lengths] = ord("<")
        own, at = _laid_out(starts, lengths - 2)
        padded[at - starts[own] + (after - lengths + 1)[own]] = data[at]
        # Where characters begin, in bytes, and where words end, in characters.
        chars = np.append(np.flatnonzero((padded & 0xC0) != 0x80), len(padded))
        last = np.searchsorted(chars, after)
        of_char = np.repeat(np.arange(len(last)), np.diff(last, prepend=0))
        left = last[of_char] - np.arange(len(of_char))
        any_known = np.zeros(len(last), dtype=bool)
        found_word, found_row = [], []
        for n in range(self.longest, 0, -1):
            begins = np.flatnonzero((left >= n) & ~any_known[of_char])
            codes = words.word_hashes(padded, chars[begins], chars[begins + n])
            row = self.grams.rows_of(codes)
            word, row = of_char[begins][row >= 0], row[row >= 0]
            any_known[word] = True
            found_word.append(word)
            found_row.append(row)
        word, row = np.concatenate(found_word), np.concatenate(found_row)
        return self.gram_logs.means(row, word, len(last)), any_known

    def predict(
        self, text: str | None, cache: dict[str, np.ndarray] | None = None
    ) -> tuple[str, float]:
        """The language of one text; ``cache`` is not used."""
        languages, scores = self.predict_all([text])
        return languages[0], scores[0]

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The languages of the texts and their shares of belief."""
        languages, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return languages, scores.tolist()
        # So many sums at a time.
        step = max(1, _CELLS // len(self.languages))
        for begin in range(0, len(texts), step):
            some = texts[begin : begin + step]
            total, n_words = self._totals(some)
            known = np.flatnonzero(n_words)
            total, n_words = total[known], n_words[known]
            logs = total * (np.minimum(n_words, EVIDENCE_WORDS) / n_words)[:, None]
            shares = np.exp(logs - logs.max(axis=1, keepdims=True))
            best = total.argmax(axis=1)
            scores[begin + known] = shares[np.arange(len(known)), best] / shares.sum(axis=1)
            for at, lang in zip(known.tolist(), best.tolist()):
                languages[begin + at] = self.languages[lang]
        return languages, scores.tolist()

    def _totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The evidence of each text for each language, and its number of words."""
        total = np.tile(self.prior, (len(texts), 1))
        n_words = np.zeros(len(texts), dtype=np.int64)
        for begin, parts in _parts(texts):
            data, starts, ends, of_part = _words_of(parts)
            code = pa.array(words.word_hashes(data, starts, ends)).dictionary_encode()
            which = code.indices.to_numpy().astype(np.int64)
            row = self.words.rows_of(code.dictionary.to_numpy())
            known = row[which] >= 0
            sums = self.word_logs.summed(
                row[which[known]], of_part[known], np.ones(known.sum()), len(parts)
            )
            # Words not known are looked up once for all their places, so many sums at a time.
            place = np.zeros(len(row), dtype=np.int64)
            place[which] = np.arange(len(which))
            place = place[row < 0]
            new, of_new = (np.cumsum(row < 0) - 1)[which[~known]], of_part[~known]
            step = max(1, _CELLS // len(self.languages))
            for at in range(0, len(place), step):
                some = place[at : at + step]
                logs, any_known = self.all_unseen(data, starts[some], ends[some])
                mine = (new >= at) & (new < at + step)
                own = new[mine] - at
                times = any_known[own].astype(float)
                sums += logs.summed(own, of_new[mine], times, len(parts))
            total[begin : begin + len(parts)] += sums
            n_words[begin : begin + len(parts)] += np.bincount(of_part, minlength=len(parts))
        return total, n_words


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Lower-cased texts, some consecutive ones at a time, and the place of the first. A long
    text is cut between words into several parts."""
    begin, held, size = 0, [], 0
    for at, text in enumerate(texts):
        text = text.lower() if text else ""
        done = 0
        while size + len(text) - done >= _PART:
            cut = _NO_LETTER.search(text, done + _PART - size)
            stop = cut.start() if cut else len(text)
            yield begin, [*held, text[done:stop]]
            begin, held, size, done = at, [], 0, stop
        held.append(text[done:])
        size += len(text) - done
    if held:
        yield begin, held


def _words_of(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the parts, where the words in them start and end, and the part of each."""
    joined = "\n".join(parts)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data) == len(joined):
        chars, codes = None, data
    else:
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # The pattern alone says what a letter is; it is asked once for each character that occurs.
    occurs = np.flatnonzero(np.bincount(codes))
    letter = np.zeros(occurs[-1] + 1 if len(occurs) else 0, dtype=bool)
    letter[occurs] = [_WORD.match(chr(code)) is not None for code in occurs.tolist()]
    turns = np.flatnonzero(np.diff(letter[codes], prepend=False, append=False))
    starts, ends = turns[::2], turns[1::2]
    first = np.cumsum([0, *(len(part) + 1 for part in parts)])
    of_part = np.searchsorted(first, starts, side="right") - 1
    if chars is not None:
        starts, ends = chars[starts], chars[ends]
    return data, starts, ends, of_part


def fit(
    documents: DataFrame,
    per_language: int = PER_LANGUAGE,
    longest: int = LONGEST_GRAM,
    most_documents: int = MOST_DOCUMENTS,
) -> LanguageModel:
    """Learn from ``documents(doc_id, text, lang)``; rows without any of them are left out."""
    labelled = documents.select("doc_id", "text", "lang").dropna()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    n_languages = labelled.select("lang").distinct().count()
    each = max(1, min(per_language, most_documents // max(n_languages, 1)))
    chosen = (
        labelled.select("doc_id", "lang")
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= each)
        .select("doc_id", "lang")
    )
    # The ids are few by the bounds above, so only texts of the sample leave their tasks.
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").dropDuplicates(
        ["doc_id", "lang"]
    )
    counts = stored(
        sample.select("lang", "text")
        .mapInArrow(_word_counts, "lang string, item string, n long")
        .groupBy("lang", "item")
        .agg(F.sum("n").alias("n")),
        "word-counts",
    )
    known = _collected(counts)
    # An n-gram counts once per distinct word, since it is to judge words not seen before.
    padded = F.concat(F.lit("<"), "item", F.lit(">"))
    cut = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(longest)),
            lambda n: F.transform(
                F.filter(
                    F.sequence(F.lit(1), F.length(padded)),
                    lambda at: at + n - 1 <= F.length(padded),
                ),
                lambda at: F.substring(padded, at, n),
            ),
        )
    )
    grams = (
        counts.select("lang", F.explode(cut).alias("item"))
        .where("item NOT IN ('<', '>')")
        .groupBy("lang", "item")
        .agg(F.count("*").alias("n"))
    )
    languages = sorted(known.column("lang").unique().to_pylist())
    of_words = _table(known, languages)
    of_grams = _table(_collected(grams), languages)
    totals = np.bincount(
        _language(known, languages), known.column("n").to_numpy(), len(languages)
    )
    return LanguageModel(languages, np.log(totals), of_words, of_grams, longest)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, word) for word in _WORD.findall(text.lower()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang for lang, _ in counts], pa.string()),
                pa.array([word for _, word in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "item", "n"],
        )


def _collected(counts: DataFrame) -> pa.Table:
    """``lang, code, n`` with the hash of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = hashes(batch.column("item").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(code), batch.column("n")], ["lang", "code", "n"]
            )

    return counts.select("lang", "item", "n").mapInArrow(run, "lang string, code long, n long").toArrow()


def _language(rows: pa.Table, languages: list[str]) -> np.ndarray:
    return pc.index_in(rows.column("lang"), pa.array(languages, pa.string())).to_numpy().astype(np.int64)


def _table(rows: pa.Table, languages: list[str]) -> dict[str, np.ndarray]:
    """Sorted hashes of the items; where the languages of each begin; the languages, and by how
    much their log frequency is above that of an item which they do not have (``absent``)."""
    code = rows.column("code").to_numpy().view(np.uint64)
    lang, n = _language(rows, languages), rows.column("n").to_numpy()
    order = np.lexsort((lang, code))
    code, lang, n = code[order], lang[order], n[order]
    codes, first = np.unique(code, return_index=True)
    totals = np.bincount(lang, n, len(languages)) + _SMALLEST * len(codes)
    return {
        "codes": codes,
        "first": np.append(first, len(code)),
        "lang": lang.astype(np.int32),
        "more": np.log((n + _SMALLEST) / _SMALLEST).astype(np.float32),
        "absent": np.log(_SMALLEST / np.maximum(totals, _SMALLEST)),
    }


def with_language(
    documents: DataFrame, model: LanguageModel, into: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Add the predicted language and its share of belief, 0 to 1, from ``text`` alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the
    model has learned no language. Columns that already have the names of ``into`` are replaced.
    Every row of the input gives one row.
    """
    others = documents.drop(*into)
    shared = documents.sparkSession.sparkContext.broadcast(model.plain)
    schema = StructType(
        [
            *others.schema.fields,
            StructField(into[0], StringType()),
            StructField(into[1], DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(**shared.value)
        for batch in batches:
            for row, run_of_texts in words.slices(batch.column("text")):
                languages, scores = own.predict_all(run_of_texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(row, len(run_of_texts)).columns,
                        pa.array(languages, pa.string()),
                        pa.array(scores, pa.float64()),
                    ],
                    schema.names,
                )

    return others.mapInArrow(run, schema)


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id as text falls into the part kept from learning."""
    own = F.crc32(F.col(doc_id).cast("string")) % parts == part
    return F.coalesce(own, F.lit(False))
