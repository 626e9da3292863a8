"""Text that was decoded with a wrong character encoding: found by description length, restored where possible.

Every reading of a text (as it is, and re-encoded and decoded again along a chain of encodings) is compressed with a
zstandard dictionary per language, which holds the phrases that save most over all texts. A reading's description length is its smallest compressed size, plus what the
characters outside that language's alphabet cost, plus the cost of its chain. The shortest description wins; on a tie
the text stays as it is."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkslide.sources.tables import written

# Letters beyond ASCII of each language, lower case.
ALPHABETS = {
    "en": "",
    "de": "äöüß",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "es": "áéíñóúü",
    "pt": "àáâãçéêíóôõúü",
    "pl": "ąćęłńóśźż",
    "cs": "áčďéěíňóřšťúůýž",
    "tr": "âçğıiöşüû",
    "nordic": "áåäæéíðóöøúýþ",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "ja": "",
}
# Signs that any language may use.
SIGNS = "©®™°№€£§«»“”„‘’‚–—…•·×÷±½¼¾µμ′″¿¡ªº²³ 、。「」・（）"
REPLACEMENT = "�"
# Fixed values: (read as, really) pairs of encodings that get confused; "windows" is cp1252 whose five unassigned bytes
# stand for the control characters of latin-1.
UTF8_READ_AS = ["windows", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp866", "koi8_r"]
ONE_BYTE = [
    ("windows", "cp1251"),
    ("windows", "koi8_r"),
    ("windows", "cp866"),
    ("windows", "cp1250"),
    ("windows", "cp850"),
    ("windows", "cp437"),
    ("windows", "mac_roman"),
    ("windows", "cp932"),
    ("windows", "euc_jp"),
    ("cp1251", "windows"),
    ("cp1250", "windows"),
    ("mac_roman", "windows"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
]
ESCAPE = 3.0  # bytes that an anomaly costs: a foreign letter or a sign after a letter
STRONG = 3  # a broken case, or two scripts or a sign inside a word, cost so many times that
LOST = 2.0  # bytes that a lost character costs
STEP = 1.5  # bytes that each step of a chain costs
RARE = 1.0  # bytes more for a step that isn't through the windows code page
DOUBT = 12.0  # bytes more where the text as it is has no anomaly and the chain doesn't end in UTF-8
EVIDENCE = 1.0  # bytes less for each character saved by a chain through UTF-8, which other text rarely survives
MOST_EVIDENCE = 4
LEVEL = 3
LEAST_FRAME = 4  # bytes of the smallest compressed text
DICTIONARY_BYTES = 32768
PHRASE_WORDS = 4  # words of the longest phrase that is counted
SEQUENCE_BYTES = 2  # bytes that a reference to a phrase costs
FIRST_RANKS = 8192  # phrases of each language that are fetched at first; as many again until its dictionary is full
CACHE = 200_000

SEPARATORS = r"""\s*[;,|/•、，；"'\[\]\t\n]\s*"""  # what may stand between the values of a list
NON_ASCII = "[^\\x00-\\x7F]"


def _windows_table() -> dict[str, int]:
    table = {chr(b): b for b in range(256)}
    for b in range(0x80, 0xA0):
        try:
            table[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return table


_WINDOWS = _windows_table()
_WINDOWS_BACK = {
    b: next((c for c, x in _WINDOWS.items() if x == b and ord(c) > 255), chr(b)) for b in range(0x80, 0x100)
}


def encode(text: str, name: str) -> bytes | None:
    try:
        if name == "windows":
            return bytes([_WINDOWS[c] for c in text])
        return text.encode(name)
    except (UnicodeEncodeError, KeyError):
        return None


def decode(raw: bytes, name: str) -> str | None:
    try:
        if name == "windows":
            return "".join(chr(b) if b < 0x80 else _WINDOWS_BACK[b] for b in raw)
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def _words(text: str, change) -> str:
    """`change` applied to each word with a character beyond ASCII; a word stays where it gives None."""
    out = []
    for word in text.split(" "):
        new = None if word.isascii() else change(word)
        out.append(word if new is None else new)
    return " ".join(out)


def _repair(read_as: str, really: str):
    def change(word: str) -> str | None:
        raw = encode(word, read_as)
        return None if raw is None else decode(raw, really)

    return change


_repairs = {pair: _repair(*pair) for pair in [*((x, "utf-8") for x in UTF8_READ_AS), *ONE_BYTE]}


def _lossy(word: str) -> str | None:
    """UTF-8 read as windows, of which some bytes were lost: only for words with the first byte of a longer character
    that can't be repaired whole."""
    raw = encode(word, "windows")
    if raw is None or REPLACEMENT in word or not any(0xC2 <= b <= 0xF4 for b in raw):
        return None
    return raw.decode("utf-8", "replace")


def _multibyte(name: str) -> re.Pattern[str]:
    """Finds two characters that stand for the first two bytes of a longer UTF-8 character."""
    signs: dict[bool, list[str]] = {True: [], False: []}
    for b in range(0x80, 0xF5):
        if name == "windows":
            written = {c for c, x in _WINDOWS.items() if x == b}
        else:
            try:
                written = {bytes([b]).decode(name)}
            except UnicodeDecodeError:
                continue
        if b < 0xC0 or b >= 0xC2:
            signs[b >= 0xC2] += sorted(written)
    return re.compile(f"[{re.escape(''.join(signs[True]))}][{re.escape(''.join(signs[False]))}]")


_MULTIBYTE = {name: _multibyte(name) for name in UTF8_READ_AS}


def candidates(text: str) -> Iterator[tuple[str, str, int]]:
    """(reading, chain, steps) of the text along every chain that can be followed. Words are repaired one by one, so a
    text that is damaged in part is restored in part. UTF-8 chains may be followed twice or thrice."""
    seen = {text}
    frontier = [(text, "", 0)]
    for step in (1, 2, 3):
        found = []
        for base, chain, _ in frontier:
            for name in UTF8_READ_AS:
                if not _MULTIBYTE[name].search(base):
                    continue
                new = _words(base, _repairs[name, "utf-8"])
                if new not in seen:
                    seen.add(new)
                    found.append((new, f"{chain}{name}>utf-8 ", step))
        yield from found
        frontier = found
        if not found:
            break
    for read_as, really in ONE_BYTE:
        new = _words(text, _repairs[read_as, really])
        if new not in seen and REPLACEMENT not in new:
            seen.add(new)
            yield new, f"{read_as}>{really} ", 1
    new = _words(text, _lossy)
    if new not in seen:
        yield new, "windows>utf-8,lossy ", 2


@dataclass
class Model:
    """A compressor per language; `dictionaries` maps a language to the content of its dictionary.
    `ideographs` are the Japanese characters of the texts: others count as foreign."""

    dictionaries: dict[str, bytes]
    ideographs: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self._ready: dict[str, zstandard.ZstdCompressor] | None = None
        self._bits: dict[str, int] = {}
        self._cache: dict[str, tuple[str, str]] = {}

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "ideographs": self.ideographs}

    def __setstate__(self, state: dict) -> None:
        self.dictionaries, self.ideographs = state["dictionaries"], state["ideographs"]
        self.__post_init__()

    def _compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        """By language, English first; also fills the table of the languages that have a letter, as bits."""
        if self._ready is None:
            self._ready, self._bits = {}, {}
            for i, language in enumerate(ALPHABETS):
                raw = self.dictionaries[language]
                shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(level=LEVEL)
                self._ready[language] = zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                letters = set(ALPHABETS[language]) | {c.upper() for c in ALPHABETS[language] if len(c.upper()) == 1}
                if language == "tr":
                    letters |= {"İ"}
                if language == "ja":
                    letters |= self.ideographs
                for c in letters | set(SIGNS):
                    self._bits[c] = self._bits.get(c, 0) | 1 << i
        return self._ready

    def _fits(self, word: str) -> tuple[int, int]:
        """How many letters of a word no alphabet has that has most of them, and, if there are none, the languages that
        have all of them, as bits."""
        ready = self._compressors()
        special = [c for c in word if ord(c) > 127 and c != REPLACEMENT]
        common = -1
        for c in special:
            common &= self._bits.get(c, 0)
        if common:
            return 0, common & ((1 << len(ready)) - 1)
        return min(sum(not self._bits.get(c, 0) >> i & 1 for c in special) for i in range(len(ready))), 0

    def anomalies(self, plain: str) -> tuple[float, int]:
        """What the anomalies of a normalised reading cost, and the languages its words fit, as bits."""
        broken = sum(len(p.findall(plain)) for p in (_BROKEN_CASE, _TWO_SCRIPTS, _SIGN_IN_WORD))
        odd = STRONG * broken + len(_SIGN_AFTER.findall(plain))
        fits = 0
        for word in plain.split(" "):
            if not word.isascii():
                foreign, languages = self._fits(word)
                odd += foreign
                fits |= languages
        return ESCAPE * odd + LOST * plain.count(REPLACEMENT), fits

    def compressed(self, plain: str, fits: int) -> int:
        """The size with the best dictionary of the languages that fit; the English one if none does."""
        raw = plain.replace(REPLACEMENT, "").encode("utf-8", "surrogatepass")
        ready = self._compressors()
        return min(len(packer.compress(raw)) for i, packer in enumerate(ready.values()) if fits >> i & 1 or not fits and not i)

    def best(self, text: str) -> tuple[str, str]:
        """The reading with the shortest description, and its chain; the text itself and "" if nothing is shorter."""
        known = self._cache.get(text)
        if known is None:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            known = self._cache[text] = self._choose(text)
        return known

    def _choose(self, text: str) -> tuple[str, str]:
        if text.isascii():
            return text, ""
        plain = _normal(text)
        anomalies, fits = self.anomalies(plain)
        best, reading, chain = self.compressed(plain, fits) + anomalies, text, ""
        for new, name, steps in candidates(text):
            through_utf8 = name.endswith(">utf-8 ")
            cost = STEP * steps + RARE * sum(not x.startswith("windows>") for x in name.split())
            if through_utf8:
                cost -= EVIDENCE * min(len(text) - len(new), MOST_EVIDENCE)
            elif anomalies == 0:
                cost += DOUBT
            # A reading that can't win any more isn't compressed.
            if cost + LEAST_FRAME >= best:
                continue
            plain = _normal(new)
            left, fits = self.anomalies(plain)
            if cost + left + LEAST_FRAME >= best or not through_utf8 and left > anomalies:
                continue
            cost += left + self.compressed(plain, fits)
            if cost < best:
                best, reading, chain = cost, new, name
        return reading, chain.strip()

    def damaged(self, text: str) -> bool:
        """Whether the text was decoded wrongly: a better reading exists, or characters were replaced for good."""
        return REPLACEMENT in text or bool(self.best(text)[1])


# A small letter before a capital one, at least one of them beyond ASCII; a sign right after a letter; Latin letters
# next to Cyrillic ones or to ideographs.
_SMALL, _LARGE = "ß-öø-ÿ", "À-ÖØ-Þ"
_BROKEN_CASE = re.compile(f"(?<=[a-z{_SMALL}])[{_LARGE}]|(?<=[а-яё])[А-ЯЁ]")
_SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[^\w\s\x00-\x7f’—·、。，；：！？「」（）・\u0300-\u036f](?=[^\W\d_])")
_SIGN_AFTER = re.compile(
    r"(?<=[^\W\d_])[^\w\s\x00-\x7f’”“»›…–—·•、。，；：！？」）・\u0300-\u036f](?![^\W\d_])"
)
_TWO_SCRIPTS = re.compile("[A-Za-zÀ-ɏ][Ѐ-ӿ一-鿿]|[Ѐ-ӿ一-鿿][A-Za-zÀ-ɏ]")


def _normal(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _japanese(c: str) -> bool:
    return "　" <= c <= "ヿ" or "一" <= c <= "鿿" or "！" <= c <= "～"


def language_of(text: str) -> str | None:
    """The language whose alphabet the text fits best, by the rarest of its letters; None if it fits none."""
    plain = unicodedata.normalize("NFC", text)
    special = {c.lower() for c in plain if ord(c) > 127 and c not in SIGNS}
    if not special:
        return "en"
    if all(_japanese(c) for c in special):
        return "ja"
    fits = [x for x, letters in ALPHABETS.items() if letters and special <= set(letters)]
    for marks, language in (("ßä", "de"), ("ñ", "es"), ("ãõ", "pt"), ("ğşı", "tr"), ("ðæøåþ", "nordic")):
        if language in fits and special & set(marks):
            return language
    return fits[0] if fits else None


def _through_utf8(text: str) -> bool:
    """Whether some chain through UTF-8 can be followed."""
    return any(
        _MULTIBYTE[name].search(text) and _words(text, _repairs[name, "utf-8"]) != text for name in UTF8_READ_AS
    )


def sound(text: str) -> str | None:
    """The language of a text that dictionaries are made from. None for one that some UTF-8 chain could repair whole or in
    part, with control or replacement characters, or that fits no alphabet: it might be damaged itself."""
    if 2 * sum(map(str.isalpha, text)) < len(text):
        return None  # numbers and times are no language
    if text.isascii():
        return "en"
    if REPLACEMENT in text or re.search("[\x80-\x9f]", text) or _BROKEN_CASE.search(text) or _through_utf8(text):
        return None
    return language_of(text)


def phrases(text: str) -> set[str]:
    """The runs of one to four words of a text, each with the blank after it."""
    words = [w + " " for w in text.split(" ")]
    words[-1] = words[-1][:-1]
    n = len(words)
    return {"".join(words[i:j]) for i in range(n) for j in range(i + 1, min(i + PHRASE_WORDS, n) + 1)} - {""}


def count_phrases(texts: Iterable[str | None]) -> Counter:
    """Counts (language, phrase): in how many of the texts of a language a phrase occurs. The Japanese characters are
    counted too, under no language."""
    out: Counter = Counter()
    for text in texts:
        language = sound(text) if text else None
        if language:
            plain = _normal(text)
            out.update([(language, p) for p in phrases(plain)])
            if language == "ja":
                out.update([("", c) for c in set(plain) if _japanese(c)])
    return out


def _saved(phrase: str, count: int) -> int:
    """Bytes that a phrase in the dictionary saves over all texts."""
    return count * (len(phrase.encode("utf-8", "surrogatepass")) - SEQUENCE_BYTES)


def _fill(ranked: list[str], room: int) -> tuple[list[str], bool]:
    """The first phrases that fit in, without those that stand in others before them, and whether the room is full."""
    out: list[str] = []
    joined, size = "", 0
    for phrase in ranked:
        if phrase in joined:
            continue
        size += len(phrase.encode("utf-8", "surrogatepass"))
        if size > room:
            return out, True
        out.append(phrase)
        joined += phrase + "\0"
    return out, False


def _dictionaries(ranked: dict[str, list[str]], most: int | None = None) -> tuple[dict[str, bytes], bool]:
    """The content of each dictionary from the phrases of each language, which save most first, and whether more phrases
    would change none: a dictionary is full, or its language has fewer phrases than the `most` that were fetched.

    Half of a dictionary is its language's own, the rest is what all languages share, so that only the language's own text
    tells them apart. The phrases that save most stand last, where references to them are shortest."""
    out: dict[str, bytes] = {}
    settled = True
    ended = {x: most is None or len(ranked.get(x, [])) < most for x in ALPHABETS}
    for language in ALPHABETS:
        own, full = _fill(ranked.get(language, []), DICTIONARY_BYTES // (1 if language == "en" else 2))
        settled &= full or ended[language]
        if language != "en":
            taken = sum(len(p.encode("utf-8", "surrogatepass")) for p in own)
            common, full = _fill(ranked.get("en", []), DICTIONARY_BYTES - taken)
            settled &= full or ended["en"]
            own += common
        raw = "".join(reversed(own)).encode("utf-8", "surrogatepass")
        out[language] = raw if len(raw) >= 8 else (ALPHABETS[language] or "the of and ").encode()
    return out, settled


def train(texts: Iterable[str]) -> Model:
    """The model of texts that are all at hand."""
    ranked: dict[str, list[str]] = {}
    counts = count_phrases(texts)
    for language, phrase in sorted(counts, key=lambda k: (-_saved(k[1], counts[k]), k[1])):
        if language and _saved(phrase, 1) > 0:
            ranked.setdefault(language, []).append(phrase)
    return Model(_dictionaries(ranked)[0], frozenset(c for language, c in counts if not language))


def texts_in(entries: Column, lists: list[str]) -> Column:
    """The distinct texts of a map that hold a character beyond ASCII. The entries named in `lists` hold several values,
    which may be of several languages, so each of those is a text."""
    values = F.filter(F.map_entries(entries), lambda e: e["value"].rlike(NON_ASCII))
    parts = F.transform(
        values,
        lambda e: F.when(
            F.substring_index(e["key"], ":", -1).isin(lists),
            F.filter(F.split(e["value"], SEPARATORS), lambda x: x.rlike(NON_ASCII)),
        ).otherwise(F.array(e["value"])),
    )
    return F.array_distinct(F.flatten(parts))


def texts_of(json_col: Column, lists: list[str]) -> Column:
    """The texts of a JSON object."""
    return texts_in(F.from_json(json_col, "map<string,string>"), lists)


def train_on(df: DataFrame, json_col: str) -> Model:
    """The model of all values of a column of JSON objects, each different one counted once.

    Phrases are counted where the texts are; the driver gets those that save most, as many as fill the dictionaries."""
    values = F.map_values(F.from_json(F.col(json_col), "map<string,string>"))
    texts = df.select(F.explode(values).alias("v")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_phrases(batch.column("v").to_pylist())
            columns = [pa.array([k[i] for k in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(list(found.values()), pa.int64())], names=["language", "phrase", "n"]
            )

    counts = texts.mapInArrow(count, "language string, phrase string, n bigint")
    counts = counts.groupBy("language", "phrase").agg(F.sum("n").alias("n"))
    saved = F.col("n") * (F.octet_length("phrase") - SEQUENCE_BYTES)
    counts = written(counts.select("language", "phrase", saved.alias("saved")), "phrases")
    seen = frozenset(r["phrase"] for r in counts.where("language = ''").select("phrase").collect())
    best_first = Window.partitionBy("language").orderBy(F.desc("saved"), "phrase")
    ranks = counts.where("language <> '' and saved > 0").withColumn("rank", F.row_number().over(best_first))
    most = FIRST_RANKS
    while True:
        ranked: dict[str, list[str]] = {}
        for r in sorted(ranks.where(F.col("rank") <= most).collect(), key=lambda r: r["rank"]):
            ranked.setdefault(r["language"], []).append(r["phrase"])
        made, settled = _dictionaries(ranked, most)
        if settled:
            return Model(made, seen)
        most *= 2


def find_damaged(df: DataFrame, texts: str, model: Model) -> DataFrame:
    """The rows of `df` for which at least one of the array `texts` is damaged, without that column.

    Null and empty arrays, null and plain ASCII texts are undamaged. Texts are judged whole, however long. One narrow
    stage; what was judged before is remembered within a task's worker, up to a bound."""
    keep = [c for c in df.columns if c != texts]
    kinds = dict(df.dtypes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [
                any(t is not None and model.damaged(t) for t in (row or ())) for row in batch.column(texts).to_pylist()
            ]
            yield batch.select(keep).filter(pa.array(flags, pa.bool_()))

    return df.mapInArrow(judge, ", ".join(f"`{c}` {kinds[c]}" for c in keep))


def restore(df: DataFrame, text: str, model: Model) -> DataFrame:
    """`df` plus restored (the best reading; the text itself where nothing better is known), chain (how it was got, ""
    for none) and damaged. Null texts stay null and are undamaged. Columns that have these names already are replaced."""
    df = df.drop("restored", "chain", "damaged")
    kinds = dict(df.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(text).to_pylist()
            made = [(None, "") if v is None else model.best(v) for v in values]
            damaged = [v is not None and (REPLACEMENT in v or bool(c)) for v, (_, c) in zip(values, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.string()),
                    pa.array(damaged, pa.bool_()),
                ],
                names=[*batch.schema.names, "restored", "chain", "damaged"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns) + ", restored string, chain string, damaged boolean"
    return df.mapInArrow(work, schema)
