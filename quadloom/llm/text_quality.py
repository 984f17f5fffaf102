"""Per-document text statistics, and telling running prose from code, lists, tables and junk.

Every Arrow batch is worked on as one buffer of bytes: lines and words are found by
scanning it with NumPy, equal words are described once (digits count as equal for
this), and the descriptions are summed by line and by document. Words of over
_LONG bytes are described as exactly as others, but not kept from batch to batch.

Layout signals, after which lines and documents are told apart:

* vertical delimiter alignment: a bar, tab or gap of spaces at the same column of
  the line above or below; two of them make a table row;
* indentation periodicity: the share of indented lines at a multiple of the
  document's step of 2 or 4 (4 if over three quarters of its evenly indented
  lines are at multiples of 4; a tab counts as 4);
* line-length autocorrelation: of each line's length with the next one's.

Lines are candidates for prose if they are mostly words and neither headings, list
items, table rows, cell marks nor log lines. Adjacent candidates form a block, and
a block is running sentences by its word, symbol and punctuation ratios. Letters
outnumber signs, and then either

* a sixth to three quarters of its words are `common_words`, these are spread as
  in sentences (at most a third of the pairs of adjacent words within a clause are
  two of them, or five in six of those that chance would make, or capitals open
  nine in ten sentences), and clauses don't end on them (at most half of the words
  before a comma or stop; of 3 and more). Heaps of words fail one of these, as
  their words follow each other by chance; or
* it has too few of them, as in languages that `common_words` lacks: it ends as a
  sentence, 1 to 10 in 40 words close one, nearly all its words are words, without
  signs of code, and it is written in sentence case (a capital opens each sentence,
  and few words else) or a fifth are short words in lower case (of at most 3
  letters). Scripts without spaces between words need a stop for every line or
  four characters a word. A sentence of such a language that ends without
  punctuation isn't told.

Whatever its words, a block of which at most a quarter of the lines end in closing
punctuation is a list without marks if

* it is nested: of 3 and more lines, all indented by multiples of the step, the
  indentation changes twice and more, and grows after a line that is no
  sentence's end (where prose indents paragraphs, it grows after an end); or
* it alternates: its 6 and more lines are by turns below and above their mean
  length, below it first (a wrapped sentence has its short line last); the length
  autocorrelation is at least three quarters of that of a strict change between
  two lengths, and the deviation a third of the mean (short lines half as long as
  long ones). Lines of one sentence each fail one of these but by rare chance.

Defined results: a null, empty or blank text has no lines; its counts are 0, its
ratios null and its kind `blank`. Lines end at LF or CR. Texts are never cut.
Equal texts have equal statistics. An empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quadloom.llm.tokens import _bytes_of, _small_batches

_EDGE = "“”\"'«»„‚‘’()[]¿¡*_~.,;:!?…—–-`​﻿"
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-\u200c][\p{L}\p{M}]+)*")
_CASE = regex.compile(r"[\p{L}\p{M}]?[\p{Ll}\p{Lo}\p{Lm}\p{M}]*(?:['’\-\u200c][\p{L}\p{M}]+)*|\p{Lu}{1,6}")
#: Ends of sentences, of the Latin, Greek, East Asian, Indic, Arabic, Armenian and Ethiopic scripts.
_ENDS = (".", "!", "?", "…", "。", "！", "？", "．", "।", "॥", "؟", "۔", "։", "።", "၊", "။", "។")
_CLAUSE = (*_ENDS, ",", ";", ":", "、", "，", "；", "：", "،", "؛")
_CODE = re.compile(r"[=(){}\[\];<>|\\/_$#@%^&+~`]|\w[.:]\w")
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_FAULT = re.compile(r"[A-Za-z]*(?:Error|Exception|Warning):")
_DATA_ROW, _HEAD, _LIST, _QUOTE, _MARK, _IMPORT = 1, 2, 3, 4, 5, 6
_LIST_HEAD = re.compile(r"[-*+•‣◦·]|\(?(?:0{1,3}|[a-z])[.)]")
#: Most of the pairs of words within a clause (or of the pairs that chance would make), and of the words that clauses end on, that are function words in sentences.
_PAIRED, _BY_CHANCE, _CLOSED_ON = 1 / 3, 5 / 6, 1 / 2
_LETTERS = string.ascii_letters.encode()
_LONG = 64
FEATURES = ("word", "common", "clause", "upper", "code", "letters", "symbols", "chars", "ends", "head", "tiny")


class Words:
    """Descriptions of words, a row of FEATURES each; the cache is bounded."""

    def __init__(self, common: frozenset[str], cached: int = 200_000):
        self.common, self.cached = common, cached
        self.known: dict[bytes, tuple[int, ...]] = {}

    def describe(self, token: bytes) -> tuple[int, ...]:
        text = token.decode("utf-8", "replace")
        bare = text.strip("​﻿")
        core = bare.strip(_EDGE)
        low = core.lower()
        if text.isascii():
            letters, symbols = len(token) - len(token.translate(None, _LETTERS)), len(token.translate(None, _LETTERS + b"0123456789"))
        else:
            letters, symbols = sum(map(str.isalpha, text)), len(text) - sum(map(str.isalnum, text))
        word = int(len(core) <= 30 and bool(_WORD.fullmatch(core)) and bool(_CASE.fullmatch(core)) and bare[0] not in "`$")
        east = 0 if core.isascii() else len(_EAST.findall(core))
        if east >= 4:
            word = max(1, east // 2)
        elif east == 0 and word and not core.isascii() and len(core) > 3 and sum(c.isupper() for c in core) > 2:
            word = 0
        closing = bare.rstrip("”\"'»’)*_」』")
        ends = int(closing.endswith(_ENDS))
        head = 0
        if bare.startswith("#"):
            head = _HEAD
        elif _LIST_HEAD.fullmatch(bare) or (bare.startswith("`") and bare.endswith("`:")):
            head = _LIST
        elif bare in ("import", "from"):
            head = _IMPORT
        elif bare.strip(">") == "" and bare:
            head = _QUOTE
        elif bare.startswith(("|", "+-", "+=")) and not bare.startswith("+= "):
            head = _DATA_ROW if bare != "+=" else 0
        elif bare.startswith(("```", "~~~", "%", "!", "In[", "Out[", "[", "---", "===", "@", "{", "}", "</", "<!", "\x1b")) or _FAULT.match(bare) or (bare.startswith("/") and ":" in bare):
            head = _MARK if not re.match(r"\[[^\W\d_]", bare) else 0
        code = int(bool(_CODE.search(core)) or (not core and bool(_CODE.search(bare))))
        common = int(bool(word) and low in self.common)
        tiny = int(word == 1 and len(core) <= 3 and core == low)
        return (word, common, int(closing.endswith(_CLAUSE)), int(core[:1].isupper()), code, letters, symbols, len(text), ends, head, tiny)

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.cached:
            known.clear()
        out = []
        for t in tokens:
            row = known.get(t)
            if row is None:
                row = self.describe(t)
                if len(t) <= _LONG:
                    known[t] = row
            out.append(row)
        return np.array(out, np.int32).reshape(len(out), len(FEATURES))


_BREAK = np.zeros(256, bool)
_BREAK[[10, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_DIGITLESS = np.arange(256, dtype=np.uint8)
_DIGITLESS[48:58] = 48


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _aligned(line: np.ndarray, column: np.ndarray, span: int) -> np.ndarray:
    """Which delimiters have one at the same column of the line before or after; both arrays ascend by line and column."""
    key = line.astype(np.int64) * span + column
    has = np.zeros(len(key), bool)
    for step in (-span, span):
        at = np.searchsorted(key, key + step)
        has |= (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step)
    return has


def _lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the lines; breaks belong to no line."""
    stop = np.flatnonzero(_BREAK[data])
    inner_starts = ends[:-1]
    begin = np.union1d(np.concatenate([[0], stop + 1]), inner_starts)
    begin = begin[begin < len(data)]
    finish = np.concatenate([begin[1:], [len(data)]])
    cut = _BREAK[data[finish - 1]]
    return begin, finish - cut, np.searchsorted(ends, begin, "right")


def _tight(data: np.ndarray, sign: int, begin: np.ndarray, m: int) -> np.ndarray:
    """How often `sign` stands between two characters other than blanks (the next no closing quote), by line."""
    at = np.flatnonzero(data[1:-1] == sign) + 1
    at = at[~_BLANK[data[at - 1]] & ~_BLANK[data[at + 1]] & ((data[at + 1] < 0x80) | (data[at + 1] == 0xC3))]
    return np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=m)


def describe(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """The statistics of every text of a batch."""
    (_, data), starts, ends = _bytes_of(texts)
    n = len(starts)
    if not len(data):
        return _report(n, **{k: np.zeros(n) for k in ("lines", "prose", "tables", "lists", "codes", "words", "letters", "chars", "symbols", "ends", "common", "aligned", "delimiters", "indented", "periodic")}, auto=np.full(n, np.nan))
    begin, finish, doc = _lines(data, ends)
    m = len(begin)
    # Words: maximal runs without blanks; an offset array of alternating words and gaps is encoded without copying.
    blank = _BLANK[data].copy()
    nbsp = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
    blank[nbsp] = blank[nbsp + 1] = True
    edge = np.zeros(len(data) + 1, np.int8)
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[ends[ends < len(data)]] = 1  # a text's end ends a word
    edge[0] = edge[-1] = 1
    bounds = np.flatnonzero(edge)
    is_word = ~blank[bounds[:-1]]
    w_from, w_to = bounds[:-1][is_word], bounds[1:][is_word]
    plain = _DIGITLESS[data]
    coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(plain)])
    enc = coded.take(pa.array(np.flatnonzero(is_word))).dictionary_encode()
    table, codes = words.rows(enc.dictionary.to_pylist()), enc.indices.to_numpy()
    feature = {k: table[codes, i] for i, k in enumerate(FEATURES)}
    line = np.searchsorted(begin, w_from, "right") - 1
    by = lambda k: _sums(feature[k], line, m)
    count = np.bincount(line, minlength=m)
    full = count > 0
    first = np.searchsorted(line, np.arange(m))
    last = np.searchsorted(line, np.arange(m), "right") - 1
    at = np.minimum(first, max(0, len(w_from) - 1))
    head = np.where(full, feature["head"][at] if len(w_from) else 0, 0)
    quoted = head == _QUOTE
    second = np.minimum(at + 1, max(0, len(w_from) - 1))
    head = np.where(quoted & (count > 1), feature["head"][second] if len(w_from) else 0, head)
    head = np.where(quoted & (head == _QUOTE), 0, head)
    word, common, code = by("word"), by("common"), by("code")
    imports = (head == _IMPORT) & (_sums(feature["head"] == _IMPORT, line, m) > (feature["word"][at] > 0 if len(w_from) else 0))
    imports |= (head == _IMPORT) & (count <= 4)
    punct = full & (feature["ends"][np.maximum(last, 0)] == 1) if len(w_from) else full
    # Delimiters: bars, tabs and the ends of gaps of two and more spaces, by their column.
    space = data == 32
    gap = np.zeros(len(data), bool)
    gap[2:] = ~space[2:] & space[1:-1] & space[:-2]
    spot = np.flatnonzero((data == 124) | (data == 9) | gap)
    d_line = np.searchsorted(begin, spot, "right") - 1
    column = spot - begin[d_line]
    text_from = w_from[at] if len(w_from) else begin
    inner = (spot > text_from[d_line]) | (data[spot] == 124)
    spot, d_line, column = spot[inner], d_line[inner], column[inner]
    aligned = _aligned(d_line + doc[d_line], column, 2 * len(data) + 2) if len(spot) else np.zeros(0, bool)  # texts are kept a line apart
    bars = np.bincount(d_line[(data[spot] == 124)], minlength=m)
    tabs = np.bincount(d_line[(data[spot] == 9)], minlength=m)
    straight = _sums(aligned, d_line, m)
    lead_tabs = np.concatenate([[0], np.cumsum(data == 9)])
    indent = np.where(full, text_from - begin + 3 * (lead_tabs[text_from] - lead_tabs[begin]), 0)
    even, fours = (np.bincount(doc[(indent > 0) & (indent % x == 0)], minlength=n) for x in (2, 4))
    regular = indent % np.where(fours > 0.75 * even, 4, 2)[doc] == 0
    lengths = np.where(full, finish - begin, 0).astype(float)
    beside = np.zeros(m, bool)  # as many tabs, or commas or semicolons without a space, as a line next to it
    for sign in (tabs, _tight(data, 44, begin, m), _tight(data, 59, begin, m)):
        like = (sign[1:] > 0) & (sign[1:] == sign[:-1]) & (doc[1:] == doc[:-1])
        beside[1:] |= like
        beside[:-1] |= like
    row = full & (beside | (straight >= 2) | (head == _DATA_ROW) | (bars >= 2) | (tabs >= 2))
    item = full & ~row & (head == _LIST)
    mark = full & ~row & ((head == _HEAD) | (head == _MARK) | imports)
    able = full & ~row & ~item & ~mark & (word >= 1) & (word >= 0.5 * count) & (code <= 0.35 * count + 0.5)
    able |= full & ~row & ~item & ~mark & (word >= 4) & (common >= 2) & (word + 1 >= 1.2 * code)
    # Blocks of adjacent candidates.
    opens = able & ~(np.concatenate([[False], able[:-1]]) & (np.concatenate([[-1], doc[:-1]]) == doc))
    block = np.cumsum(opens) - 1
    k = int(block[-1]) + 1 if m and opens.any() else 0
    running, listed = np.zeros(m, bool), np.zeros(m, bool)
    if k:
        own = block[able]
        s = lambda v: _sums(v[able], own, k)
        w, c, e, all_words = s(word), s(common), s(code), s(count)
        rows, ended = s(full.astype(float)), s(punct.astype(float))
        short = w + e < np.where(rows >= 3, 6.2, np.where(ended > 0, 5, 7)) * rows  # items without a mark
        # Words in their order, by block: pairs within a clause, and what clauses end on; signs alone close the word before.
        known, clause, closing, upper = (feature[x].astype(bool) for x in ("common", "clause", "ends", "upper"))
        sign = feature["symbols"] == feature["chars"]
        for flag in (clause, closing):
            flag[:-1] |= sign[1:] & flag[1:]
        of_word = np.where(able[line], block[line], k)
        of_word, known, clause, closing, upper = (x[~sign] for x in (of_word, known, clause, closing, upper))
        b = lambda v: _sums(v, of_word, k + 1)[:k]
        same = of_word[1:] == of_word[:-1]
        joined, double, initial = (np.zeros(len(of_word), bool) for _ in range(3))
        joined[:-1] = same & ~clause[:-1]
        double[:-1] = joined[:-1] & known[:-1] & known[1:]
        initial[:1], initial[1:] = True, ~same | closing[:-1]
        clauses = b(clause)
        opened = b(initial & upper) >= 0.9 * b(initial)  # by capitals
        cased = opened & (b(upper & ~initial) <= 0.3 * w)
        spread = (opened | (b(double) <= b(joined) * np.maximum(_PAIRED, _BY_CHANCE * (c / np.maximum(w, 1)) ** 2) + 1)) & ((clauses < 3) | (b(clause & known) <= _CLOSED_ON * clauses))
        lettered = s(by("symbols")) <= s(by("letters"))
        eastern = (w > 1.5 * all_words) & lettered  # scripts without spaces count for several words
        listed_language = (c >= w / 6) & (c <= 0.75 * w) & (e <= 0.8 * w + 1) & spread
        good = (~short & (w >= 5) & lettered & listed_language) | eastern
        inside = np.zeros(m, bool)  # lines with one of their block before them
        inside[1:] = able[1:] & ~opens[1:]
        before = np.concatenate([[0], indent[:-1]])
        changes, deeper = s(inside & (indent != before)), s(inside & (indent > before) & ~np.concatenate([[False], punct[:-1]]))
        nested = (rows >= 3) & (s(regular) == rows) & (changes >= 2) & (deeper > 0)
        mean = s(lengths) / rows
        rhythm = np.nan_to_num(_autocorrelation(lengths[able], own, k)) <= -0.75 * (rows - 1) / rows
        over = np.zeros(m, bool)
        over[able] = lengths[able] > mean[own]
        turns = s(inside & (over != np.concatenate([[False], over[:-1]]))) == rows - 1
        alternates = (rows >= 6) & rhythm & turns & ~over[opens] & (s(lengths**2) / rows >= (1 + 1 / 9) * mean**2)
        marked = (nested | alternates) & (ended <= 0.25 * rows) & ~eastern
        closes = np.zeros(k, bool)  # by the last line of each block
        np.put(closes, own, punct[able])
        stops, tiny = s(by("ends")), s(by("tiny"))
        good |= ~short & (w >= 8) & (c < w / 6) & lettered & closes & (stops >= w / 40) & (stops <= w / 4) & (cased | (tiny >= 0.2 * w)) & (w >= 0.9 * all_words) & (e <= 0.1 * w)
        running[able], listed[able] = (good & ~marked)[own], marked[own]
    blocks_of = lambda v: _sums(v, doc, n)
    nonblank = np.flatnonzero(full)
    return _report(
        n,
        lines=blocks_of(full), prose=blocks_of(running), tables=blocks_of(row), lists=blocks_of(item | listed),
        codes=blocks_of(full & ~row & ~item & ~running & ~listed & ((code > 0.3 * count) | mark)),
        words=_sums(count, doc, n), letters=_sums(by("letters"), doc, n), chars=_sums(by("chars"), doc, n), symbols=_sums(by("symbols"), doc, n),
        ends=blocks_of(punct), common=_sums(common, doc, n),
        aligned=_sums(straight, doc, n), delimiters=_sums(np.bincount(d_line, minlength=m), doc, n),
        indented=blocks_of(full & (indent > 0)), periodic=blocks_of(full & (indent > 0) & regular),
        auto=_autocorrelation(lengths[nonblank], doc[nonblank], n),
    )


def _autocorrelation(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    count = np.bincount(doc, minlength=n)
    mean = _sums(x, doc, n) / np.maximum(count, 1)
    off = x - mean[doc]
    pair = doc[1:] == doc[:-1]
    both = _sums((off[1:] * off[:-1])[pair], doc[1:][pair], n)
    square = _sums(off * off, doc, n)
    return np.where((count > 2) & (square > 0), both / np.where(square > 0, square, 1), np.nan)


def _report(n: int, lines, prose, tables, lists, codes, words, letters, chars, symbols, ends, common, aligned, delimiters, indented, periodic, auto) -> dict[str, np.ndarray]:
    ratio = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), np.nan)
    share = ratio(prose, lines)
    kind = np.full(n, "junk", object)
    kind[codes >= 0.4 * np.maximum(lines, 1)] = "code"
    kind[lists >= 0.5 * np.maximum(lines, 1)] = "list"
    kind[tables >= 0.5 * np.maximum(lines, 1)] = "table"
    kind[share >= 0.5] = "prose"
    kind[lines == 0] = "blank"
    return {
        "lines": lines, "prose_lines": prose, "table_lines": tables, "list_lines": lists, "words": words,
        "mean_word_length": ratio(chars, words), "letter_ratio": ratio(letters, chars), "symbol_ratio": ratio(symbols, chars), "punctuated_share": ratio(ends, lines),
        "common_share": ratio(common, words), "aligned_share": ratio(aligned, delimiters), "indent_periodicity": ratio(periodic, indented),
        "length_autocorrelation": auto, "prose_share": share, "kind": kind,
    }


_COUNTS = ("lines", "prose_lines", "table_lines", "list_lines", "words")
_RATIOS = ("mean_word_length", "letter_ratio", "symbol_ratio", "punctuated_share", "common_share", "aligned_share", "indent_periodicity", "length_autocorrelation", "prose_share")


def text_statistics(df: DataFrame, key: str, text: str, common_words: DataFrame, word: str = "word", max_words: int = 20_000) -> DataFrame:
    """(key, counts, ratios, kind) of every text. One row for every row of `df`; no shuffle.

    `common_words` is a short list and is sent to all workers; a list of over
    `max_words` is refused.
    """
    found = common_words.select(word).dropna().distinct().limit(max_words + 1).collect()
    if len(found) > max_words:
        raise ValueError(f"more than {max_words} common words")
    common = frozenset(r[0].lower() for r in found)
    name, kind = key, df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(common)
        for batch in _small_batches(batches, 4 << 20):
            got = describe(batch.column(1), words)
            columns = [batch.column(0), *(pa.array(got[c].astype(np.int64)) for c in _COUNTS), *(pa.array(got[c], pa.float64(), mask=np.isnan(got[c])) for c in _RATIOS), pa.array(list(got["kind"]), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[name, *_COUNTS, *_RATIOS, "kind"])

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in _RATIOS) + ", kind string"
    return df.select(key, text).mapInArrow(run, schema)
