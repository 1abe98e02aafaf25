"""Text decoded with the wrong encoding: which records are garbled, and the text as it was.

Character trigram models with interpolated smoothing are trained on the clean records of the corpus. For a record that
some encode-decode chain could have produced, every chain up to a depth is undone and scored; the likeliest text is
accepted if it beats the record as it stands by a margin, which is validated on held-out clean records and on the same
records garbled on purpose. Records with replacement characters are garbled beyond full repair.

What a chain gains is a sum over the places of a text that are not ASCII, and such places repeat: gains are remembered
by place, and a text goes through the search only if some chain gains on it in sum, or holds bytes of UTF-8.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.runtime import cores, cut

#: Encodings with which UTF-8 is read by mistake: one byte a character, and several.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "iso8859-15")
WIDE_FOR_UTF8 = ("cp932", "gbk", "big5")
#: (right, wrong) encodings of one byte a character, and the double-byte ones that are read as those or as each other.
WRONG_FOR_OTHERS = (
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("iso8859-5", "cp1252"), ("iso8859-5", "latin-1"), ("mac_cyrillic", "mac_roman"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("shift_jis", "cp1252"), ("shift_jis", "latin-1"), ("shift_jis", "mac_roman"), ("shift_jis", "cp437"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"),
    ("euc_jp", "cp932"), ("shift_jis", "euc_jp"), ("shift_jis", "gbk"), ("euc_jp", "gbk"),
)
DOUBLE = ("shift_jis", "euc_jp", "cp932", "gbk", "big5")
DEPTH = 3
#: Odds that are asked for a step beside how rare it is.
ODDS = 1000
#: Weights of the trigram, bigram and unigram estimates.
WEIGHTS = (0.75, 0.2, 0.05)
NGRAMS = 400_000  # most frequent n-grams kept in the model; rarer ones are smoothed


@lru_cache(maxsize=None)
def to_bytes(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes that the encoding leaves undefined stand as the control of that number."""
    out = {}
    for b in range(128, 256):
        out[chr(b)] = b if b < 160 else out.get(chr(b), b if encoding == "latin-1" else -1)
    out = {c: b for c, b in out.items() if b >= 0}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def utf8_shape(encoding: str) -> re.Pattern:
    """Runs of characters that are well-formed multi-byte UTF-8 when taken back to bytes."""
    chars: dict[int, str] = {}
    for c, b in to_bytes(encoding).items():
        chars[b] = chars.get(b, "") + c
    group = lambda a, z: "[" + "".join(re.escape(chars.get(b, "")) for b in range(a, z + 1)) + "]"
    tail = group(0x80, 0xBF)
    return re.compile(f"(?:{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}})+")


_BEYOND, _ASCII = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[\x00-\x7f]+")
#: A place: characters beyond ASCII with one ASCII character between them at most, so that no trigram touches two places.
_PLACE = re.compile(r"[^\x00-\x7f](?:[\x00-\x7f]?[^\x00-\x7f]+)*")
#: The same for encodings whose characters may end with an ASCII byte.
_WIDE_PLACE = re.compile(r"[^\x00-\x7f](?:[\x00-\x7f]?[^\x00-\x7f@-~]*)*?[^\x00-\x7f@-~]*[@-~]*(?![^\x00-\x7f])")
#: Length of a place beyond which sums stop once they cannot be gains any more.
_LONG = 24


_TWO = re.compile(r"[^\x00-\x7f]{2}")


@lru_cache(maxsize=None)
def _shapes(encodings: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(dict.fromkeys(utf8_shape(e).pattern for e in encodings)))


def holds_utf8(text: str, encodings: tuple[str, ...] = WRONG_FOR_UTF8) -> bool:
    """Whether there are bytes of UTF-8 read by one of the encodings, which have one byte a character."""
    return bool(_TWO.search(text) and _shapes(encodings).search(text))


Edit = tuple[int, int, str]  # (start, end, replacement)


def undo_utf8(text: str, encoding: str) -> list[Edit]:
    """Such runs read as UTF-8."""
    if encoding in DOUBLE:
        edits = []
        for m in _BEYOND.finditer(text):
            try:
                out = m[0].encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
            if out != m[0]:
                edits.append((m.start(), m.end(), out))
        return edits
    table, edits = to_bytes(encoding), []
    for m in utf8_shape(encoding).finditer(text):
        try:
            edits.append((m.start(), m.end(), bytes(table[c] for c in m[0]).decode("utf-8")))
        except UnicodeDecodeError:
            pass
    return edits


@lru_cache(maxsize=None)
def _runs(wrong: str, with_ascii: bool) -> re.Pattern:
    own = "".join(map(re.escape, to_bytes(wrong)))
    return re.compile(f"[{own}][{own}@-~]*" if with_ascii else f"[{own}]+")


@lru_cache(maxsize=200_000)
def _reread(run: str, right: str, wrong: str) -> str | None:
    if wrong in DOUBLE:
        try:
            return run.encode(wrong).decode(right)
        except UnicodeError:
            return None
    table = to_bytes(wrong)
    try:
        return bytes(table.get(c, ord(c)) for c in run).decode(right)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=100_000)
def fitting(own: frozenset[str]) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """(encodings that UTF-8 may have been read by, other pairs) for a text of these characters beyond ASCII: the first
    must have some of them, the wrong one of a pair all."""
    utf8 = tuple(e for e in WRONG_FOR_UTF8 if not own.isdisjoint(to_bytes(e)))
    return utf8 + WIDE_FOR_UTF8, tuple((r, w) for r, w in WRONG_FOR_OTHERS if w in DOUBLE or to_bytes(w).keys() >= own)


def beyond_ascii(text: str) -> frozenset[str]:
    return frozenset(_ASCII.sub("", text))


def undo_other(text: str, right: str, wrong: str) -> list[Edit]:
    """The characters beyond ASCII, which `wrong` must have all (see `fitting`), read by `right` instead; none if one of
    them cannot be."""
    edits = []
    for m in (_BEYOND if wrong in DOUBLE else _runs(wrong, right in DOUBLE)).finditer(text):
        out = _reread(m[0], right, wrong)
        if out is None:
            return []
        if out != m[0]:
            edits.append((m.start(), m.end(), out))
    return edits


def apply(text: str, edits: list[Edit]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


#: What a clean record does not hold: replacement characters, C1 controls, runs of letters and signs of wrong tables,
#: Cyrillic words with small letters first and capitals behind (a table with the cases exchanged).
DIRTY = re.compile("[�\x80-\x9f]|[а-яё][А-ЯЁ]{2}|[¡-ɏƒˆ˜†-›€™∀-⋿─-▟]{3,}")


def looks_clean(text: str) -> bool:
    return text.isascii() or not (DIRTY.search(text) or holds_utf8(text, WRONG_FOR_UTF8[:6]))


_DIGIT = re.compile(r"\d")


def _shape(text: str) -> str:
    return "\n\n" + _DIGIT.sub("0", text) + "\n"


@lru_cache(maxsize=100_000)
def char_class(c: str) -> str:
    """Script and case of a letter, block of a sign; ASCII signs stand for themselves."""
    code = ord(c)
    if code < 128:
        return "U" if c.isupper() else "l" if c.islower() else c
    if not c.isalpha():
        return f"s{code >> 7}"
    case = "U" if c.isupper() else "l" if c.islower() else "o"
    return case if code < 0x250 and unicodedata.decomposition(c)[:1].isalnum() else f"{case}{code >> 7 if code < 0x250 else 'x' if code < 0x370 else code >> 8}"


class Model:
    """Character trigrams, interpolated with bigrams and with the trigrams of character classes."""

    def __init__(self, counts: dict[str, int], garbled: float = 0.05):
        """`garbled`: share of records, about, that some chain has to be undone on; the rarer, the more each step costs."""
        self.n, self.cost = counts, math.log(ODDS / garbled)
        self.classes: Counter = Counter()
        self.inside: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, v in counts.items():
            if len(gram) == 3:
                x, y, z = map(char_class, gram)
                self.classes[x, y, z] += v
                self.classes[x, y] += v
                self.classes[z] += v
            elif len(gram) == 1:
                self.inside[char_class(gram)] += v
                self.kinds[char_class(gram)] += 1
        self.total = sum(self.inside.values()) or 1
        self.known: dict[str, float] = {}
        self.places: dict[str, tuple[bool, dict[int, float]]] = {}
        self.wide: dict[str, dict[int, float]] = {}

    def _log(self, gram: str) -> float:
        n, (w3, w2, w1) = self.n, WEIGHTS
        a, b, c = gram
        x, y, z = char_class(a), char_class(b), char_class(c)
        flat = (self.classes[z] + 0.05) / (self.total + 50)
        p = w1 * (self.classes[x, y, z] + 2 * flat) / (self.classes[x, y] + 2) * (n.get(c, 0) + 0.1) / (self.inside[z] + 0.1 * (self.kinds[z] + 64))
        if n.get(b):
            p += w2 * n.get(b + c, 0) / n[b]
        if n.get(a + b):
            p += w3 * n.get(gram, 0) / n[a + b]
        return math.log(p)

    def _sum(self, text: str) -> float:
        s, known, total = _DIGIT.sub("0", text), self.known, 0.0
        if len(known) > 500_000:
            known.clear()
        for k in range(len(s) - 2):
            gram = s[k : k + 3]
            p = known.get(gram)
            if p is None:
                p = known[gram] = self._log(gram)
            total += p
        return total

    def gain(self, text: str, edits: list[Edit]) -> float:
        """What the edits add to the score: only the trigrams that they touch are looked up."""
        total, k = 0.0, 0
        while k < len(edits):
            start, end, new = edits[k]
            while k + 1 < len(edits) and edits[k + 1][0] - end < 2:  # windows that touch are one
                k += 1
                new += text[end : edits[k][0]] + edits[k][2]
                end = edits[k][1]
            before, after = ("\n\n" + text[max(0, start - 2) : start])[-2:], (text[end : end + 2] + ("\n" if end + 2 > len(text) else ""))[:2]
            total += self._sum(before + new + after) - self._sum(before + text[start:end] + after)
            k += 1
        return total

    def _bound(self, old: str, new: str, two: str, behind: str) -> float:
        """What replacing `old` by `new` between two characters and those behind gains; a bound that is no gain, if that is seen early."""
        before = self._sum(two + old + behind)
        if len(new) < _LONG:
            return self._sum(two + new + behind) - before
        text, total = two + new + behind, 0.0
        for k in range(0, len(text) - 2, 8):
            total += self._sum(text[k : k + 10])
            if total < before - 60:  # every further trigram makes it less
                break
        return total - before

    def _place(self, two: str, core: str, behind: str) -> tuple[bool, dict[int, float]]:
        """(UTF-8 may be read from it, gain of each other chain that reads the place), of chains whose characters have one byte."""
        gain = lambda edits: self._bound(core, apply(core, edits), two, behind)
        gains, utf8 = {}, False
        encodings, pairs = fitting(beyond_ascii(core))
        if len(core) > 1 or "\u0800" <= core:
            tried = [undo_utf8(core, e) for e in encodings]
            utf8 = any(edits and gain(edits) > -self.cost for k, edits in enumerate(tried) if edits not in tried[:k])
        for k, (right, wrong) in enumerate(WRONG_FOR_OTHERS):
            if wrong not in DOUBLE and right not in DOUBLE and (right, wrong) in pairs:
                edits = undo_other(core, right, wrong)
                if edits:
                    gains[k] = gain(edits)
                    utf8 = utf8 or gains[k] > -self.cost and holds_utf8(apply(core, edits))
        return utf8, gains

    def _wide_place(self, two: str, core: str, behind: str) -> dict[int, float]:
        """Gain of each chain of double-byte encodings that reads the place."""
        gains = {}
        pairs = fitting(beyond_ascii(core))[1]
        for k, (right, wrong) in enumerate(WRONG_FOR_OTHERS):
            if (wrong in DOUBLE or right in DOUBLE) and (right, wrong) in pairs:
                edits = undo_other(core, right, wrong)
                if edits:
                    gains[k] = self._bound(core, apply(core, edits), two, behind)
        return gains

    def may_gain(self, text: str) -> bool:
        """False only if no chain of one step gains on the text, and reading it as UTF-8 loses more than a step may."""
        padded = "\n\n" + text + "\n\n"
        for pattern, judge in ((_PLACE, self._place), (_WIDE_PLACE, self._wide_place)):
            sums: dict[int, float] | None = None
            memory = self.places if pattern is _PLACE else self.wide
            for m in pattern.finditer(padded):
                a, b = m.span()
                key = padded[a - 2 : b + 2]
                got = memory.get(key)
                if got is None:
                    if len(memory) > 200_000:
                        memory.clear()
                    got = memory[key] = judge(key[:2], m[0], key[-2:])
                if pattern is _PLACE:
                    utf8, got = got
                    if utf8:
                        return True
                # a chain must read every place
                sums = dict(got) if sums is None else {k: v + got[k] for k, v in sums.items() if k in got} if sums else sums
            if sums and max(sums.values()) > 0:
                return True
        return False

    def best(self, text: str) -> tuple[float, str, tuple[str, ...]]:
        """(gain over the text as it stands less what its steps cost, likeliest text from which it may have come, chain
        that is undone); nothing is undone if no chain is worth its steps."""
        if text.isascii() or not self.may_gain(text):
            return 0.0, text, ()
        found: dict[str, tuple[float, tuple[str, ...]]] = {}
        frontier: dict[str, tuple[float, tuple[str, ...]]] = {text: (0.0, ())}
        for level in range(DEPTH):
            new: dict[str, tuple[float, tuple[str, ...]]] = {}
            for t, (g, chain) in frontier.items():
                if level and (t.isascii() or not self.may_gain(t)):
                    continue  # no further step gains
                encodings, pairs = fitting(beyond_ascii(t))
                steps = [(undo_utf8(t, e), f"utf-8 as {e}") for e in encodings]
                if not chain or chain[-1].startswith("utf-8"):
                    steps += [(undo_other(t, right, wrong), f"{right} as {wrong}") for right, wrong in pairs]
                for k, (edits, name) in enumerate(steps):
                    if edits and (not k or edits != steps[k - 1][0]) and (source := apply(t, edits)) not in found and source not in new and source != text:
                        more = self.gain(t, edits)
                        if more > -self.cost:  # a step that makes a text much less likely is no way back
                            new[source] = (g + more, (*chain, name))
            found |= new
            # what was not UTF-8 goes on only if it holds bytes of UTF-8
            frontier = {t: v for t, v in new.items() if v[1][-1].startswith("utf-8") or holds_utf8(t)}
        worth = lambda x: x[1][0] - self.cost * len(x[1][1])
        if DIRTY.search(text) and not any(worth(x) > 0 for x in found.items()):  # two encodings of one byte, one on the other
            for t, (g, chain) in list(found.items()):
                if len(chain) == 1 and not chain[0].startswith("utf-8"):
                    for right, wrong in fitting(beyond_ascii(t))[1]:
                        edits = undo_other(t, right, wrong)
                        if edits and (source := apply(t, edits)) not in found and source != text:
                            found[source] = (g + self.gain(t, edits), (*chain, f"{right} as {wrong}"))
        if not found:
            return 0.0, text, ()
        top = max(found.items(), key=lambda x: (worth(x), -len(x[1][1])))
        return (worth(top), top[0], top[1][1]) if worth(top) > 0 else (0.0, text, ())


_BITS = 21  # of a character's number


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): trigrams of the clean texts as numbers, counted for each batch, so that nothing grows with the corpus.

    Two numbers that no trigram has go along: records, and records that are not clean.
    """
    for b in batches:
        texts = b.column("text").to_pylist()
        clean = [t for t in texts if looks_clean(t)]
        joined = "".join(map(_shape, clean))
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int64()), pa.array([len(texts), len(texts) - len(clean)], pa.int64())], ["gram", "n"])
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(c) > 2:
            # a trigram with a line end and then another character begins in one text and ends in the next
            codes = ((c[:-2] << (2 * _BITS)) | (c[1:-1] << _BITS) | c[2:])[~((c[1:-1] == 10) & (c[:-2] != 10))]
            grams, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "n"])


def train(texts: DataFrame) -> Model:
    """A model of the clean ones among all `texts` (column text, not null)."""
    grams = cut(texts.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    said = {r["gram"]: r["n"] for r in grams.where("gram < 0").collect()}
    grams = grams.where("gram >= 0")
    mask = lambda k: F.col("gram").bitwiseAND((1 << (k * _BITS)) - 1)
    parts = grams.select("gram", "n", F.lit(3).alias("size"))
    for k in (2, 1):
        parts = parts.unionByName(grams.groupBy(mask(k).alias("gram")).agg(F.sum("n").alias("n")).withColumn("size", F.lit(k)))
    # the model's size is bounded, whatever the corpus; short grams are few and come first
    kept = parts.orderBy("size", F.desc("n"), "gram").limit(NGRAMS).toArrow()
    text = lambda code, size: "".join(chr(code >> (k * _BITS) & ((1 << _BITS) - 1)) for k in range(size - 1, -1, -1))
    return Model({text(g, k): n for g, k, n in zip(*(kept.column(c).to_pylist() for c in ("gram", "size", "n")), strict=True)}, (said.get(-2, 0) + 1) / (said.get(-1, 0) + 2))


def _calm(broadcast):
    """(gain, n): how often clean texts have each gain, counted for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gains = Counter(broadcast.value.best(t)[0] for t in b.column("text").to_pylist() if looks_clean(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(gains), pa.float64()), pa.array(list(gains.values()), pa.int64())], ["gain", "n"])

    return run


def validated_margin(broadcast, held: DataFrame) -> float:
    """What a chain must gain beyond the cost of its steps: the clean ones of `held` do not, but for one in a thousand."""
    gains = cut(held.mapInArrow(_calm(broadcast), "gain double, n long").groupBy("gain").agg(F.sum("n").alias("n")))
    n = gains.agg(F.sum("n")).first()[0] or 0
    beyond = n - 1 - int(0.999 * (n - 1))  # so many may gain more: a thousandth, of which most gain nothing at all
    for r in gains.where("gain > 0").orderBy(F.desc("gain")).limit(beyond + 1).toLocalIterator():
        beyond -= r["n"]
        if beyond < 0:
            return r["gain"]
    return 0.0


def _judge(broadcast, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        for b in batches:
            keep, restored, chain, gain, lossy = [], [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                if t.isascii():
                    continue
                g, source, how = model.best(t)
                lost = "�" in t
                if g <= margin:
                    source, how = t, ()
                if how or lost:
                    keep.append(k)
                    restored.append(source)
                    chain.append(" < ".join(how))
                    gain.append(g)
                    lossy.append(lost or "�" in source)
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("field"), part.column("text"), pa.array(restored, pa.string()), pa.array(chain, pa.string()), pa.array(gain, pa.float64()), pa.array(lossy, pa.bool_())],
                ["key", "field", "text", "restored", "chain", "gain", "lossy"],
            )

    return run


def garbled(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text, restored, chain, gain, lossy) of the fields of `df` that were decoded wrongly, in whole or part.

    `restored` is the likeliest text before, `chain` what was undone (empty if nothing could be), `lossy` tells that
    characters are lost. Null and empty texts are never garbled; equal rows come out once; keys may repeat or be null;
    an empty table gives no rows; whole texts are judged; other columns are ignored.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")
    rows = df.select(F.col(key).alias("key"), stacked).select("key", "x.field", "x.text").where("text IS NOT NULL AND text <> ''")
    texts = rows.select("text")
    model = train(texts.where(F.pmod(F.xxhash64("text"), F.lit(10)) > 0))
    broadcast = df.sparkSession.sparkContext.broadcast(model)
    # judging costs far more than its bytes tell: as many parts as there are cores, or as the session shuffles into
    parts = max(2 * cores(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = texts.where((F.pmod(F.xxhash64("text"), F.lit(10)) == 0) & F.col("text").rlike("[^\\x00-\\x7f]")).repartition(parts, "text").distinct()
    margin = validated_margin(broadcast, held)
    suspects = rows.where(F.col("text").rlike("[^\\x00-\\x7f]")).repartition(parts, "key", "field", "text").distinct()
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string("field string, text string, restored string, chain string, gain double, lossy boolean").fields])
    return suspects.mapInArrow(_judge(broadcast, margin), schema).withColumnRenamed("key", key)
