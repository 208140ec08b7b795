"""Texts that are no running language: repeated keywords, lists of links, product tags."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.runtime import cut

# Common function words of the corpus' languages written with Latin letters.
FUNCTION_WORDS = frozenset(
    """
    the a an of in on at to and or but it is was are were be been has have had not no i my me we our you he she they
    this that these than then so such as never ever every everyone should must will can do does did any some more most
    very only one who how where after before over just even for with from by if when while would could which what there up out all about into
    der die das den dem ein eine einen einem und oder aber ist war sind hat habe haben nicht kein ich mir wir uns es er
    sie im in zu zum auf an mit von vom bei nach seit für so als auch noch nur sich alles alle jeden jede ganz am aus wie dass kann sehr schon wenn wieder was man
    le la les l un une des du de et ou mais il elle est était a ont ne pas je j me m nous ma mon mes ce cette c qu que
    qui en dans sur au aux avec pour par plus s d n y à été sans rien se son sa
    el los las una unos del y o pero es era son ha han lo que me mi mis nos se su en con por para al como más si no
    ya sin muy todo he fue
    os as um uma do da dos das no na nos nas e ou mas foi são há não eu meu minha nós seu sua em com por que já sem mais
    ao pela pelo tão
    """.split()
)
# Endings of inflected Korean words.
KOREAN_ENDINGS = tuple("요 다 는 은 을 를 이 가 에 도 서 고 로 의 만 지 게 면 며 니 까 던 데 과 와 해 한 할 된 될 린 쓴 든 난 큰 운 던 년 달 째 간 분".split())
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁɡһкмтвАВЕКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνι", "aeopcyxijsdghkmtbABEKMHOPCTYXABEZHIKMNOPTYXaopvi")

_TOKEN = regex.compile(
    r"""(?P<plainword>\p{Latin}[\p{Latin}\p{M}]*+(?=,|\s(?!dot\b)))
    |(?P<link>(?:h(?:tt|xx)ps?:/?/?|//|www\b)[^\s<>"']*|[\p{L}\p{N}][\p{L}\p{N}\-]*(?:(?:\.|\(\.\)|\[\.\]|\s?\bdot\b\s?)[\p{L}\p{N}\-]+)*(?:\.|\(\.\)|\[\.\]|\s?\bdot\b\s?)(?:test|example|invalid|com|net|org|shop|info|biz|de|fr|es|pt|jp|kr|ru|io)\b(?:/[^\s<>"']*)?)
    |(?P<mark></?\p{L}+(?:\s[^<>]*)?/?>)
    |(?P<tag>[\#@][\p{L}\p{N}][\p{L}\p{N}_\-]*)
    |(?P<code>(?=[\p{Latin}\d:_\-]*\d)(?=[\p{Latin}\d:_\-]*\p{Latin})[\p{Latin}\d]+(?:[:_\-]+[\p{Latin}\d]+)*)
    |(?P<num>\d+(?:[.,:]\d+)*)
    |(?P<hira>\p{Hiragana}+)
    |(?P<kata>[\p{Katakana}ー]+)
    |(?P<han>\p{Han}+)
    |(?P<word>\p{L}[\p{L}\p{M}]*(?:[\-][\p{L}\p{M}]+)*)
    |(?P<end>[.!?。！？…]+)
    |(?P<sep>[|/·•★☆►▶→»~=<>\\*+]+|\n[\s\-–•*]*)
    |(?P<punct>[^\s\p{L}\p{N}])""",
    regex.X,
)

# Word classes. A content word that the corpus uses mostly outside of prose becomes LISTED.
CONTENT, FUNCTION, END, PUNCT, NUMBER, SEPARATOR, CODE, LINK, MARK, TAG = range(10)
LISTED, HANGUL, KANA, CLASSES = 10, 11, 14, 17
_WORDS = np.array([CONTENT, FUNCTION, LISTED, HANGUL, HANGUL + 1, HANGUL + 2, KANA, KANA + 1, KANA + 2])
_FUNCTIONS = np.array([FUNCTION, HANGUL + 1, KANA + 1])
_LISTED = np.array([LISTED, HANGUL + 2, KANA + 2])
_IS_WORD, _IS_FUNCTION, _IS_LISTED = (np.isin(np.arange(CLASSES), x) for x in (_WORDS, _FUNCTIONS, _LISTED))
_IS_ODD = np.isin(np.arange(CLASSES), [SEPARATOR, CODE, LINK, MARK, TAG])
_IS_SHOWN = _IS_WORD | np.isin(np.arange(CLASSES), [LINK, TAG, CODE])
_HANGUL_START = regex.compile(r"\p{Hangul}")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_HAN, _KANA = regex.compile(r"\p{Han}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_SCRIPTS = [regex.compile(rf"\p{{{x}}}") for x in ("Latin", "Cyrillic", "Greek", "Han", "Arabic", "Hebrew", "Thai", "Devanagari")]
_LETTERS: dict[str, int] = {}  # the place of a letter's script in _SCRIPTS, as far as met
_LOOKALIKE = regex.compile(r"\p{Cyrillic}|\p{Greek}")
_LATIN_WORD = regex.compile(r"[\p{L}\p{N}]*[A-Za-z][\p{L}\p{N}]*")
_LOOKALIKE_WORD = regex.compile(r"\p{Cyrillic}+|\p{Greek}+")
#: Tokens of a window, and the nats per token above or below which it is no prose.
WINDOW, HIGH = 21, 2.6
#: Nats per token of the text's own repetitions (see _own_cost) below which a window without function words is phrases said over and over.
LOW = 1.2
#: Texts of fewer characters (blanks aside) are short remarks; tokens don't count, as a whole link is one.
LEAST_CHARS = 60
#: A word is LISTED if it is so many nats likelier outside of prose than in it, and stands there so often, whatever the corpus' size.
LISTED_NATS, LISTED_TIMES = 1.5, 3
#: Below this share of function words a text's language is unknown, and such a part of a text no running language that is known.
FEW_FUNCTION, LITTLE_FUNCTION = 0.28, 0.18
#: Nats per token of the text's own repetitions that different sentences have at least.
NEW_WORDS = 2.0
#: Function words of an unknown language: in so many texts, at least so often among its words, and not so often in a text.
LEARNED_TEXTS, LEARNED_SHARE, LEARNED_MOST = 3, 0.004, 20
#: Words of the corpus, the most frequent ones, that tasks hold at most; rarer LISTED words come to the texts by a join.
LOCAL_WORDS = 100_000


def plain(text: str) -> str:
    """Compatibility form, without invisible characters, look-alike letters replaced."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if _LOOKALIKE.search(text):
        text = _LATIN_WORD.sub(lambda m: m[0].translate(LOOKALIKES), text)
        text = _LOOKALIKE_WORD.sub(lambda m: m[0].translate(LOOKALIKES), text)
    return text


def _word_class(group: str, s: str) -> int:
    """Class of a lower-case token; -1 for markup that is no link."""
    if group in ("word", "plainword"):
        if _HANGUL_START.match(s):
            return HANGUL + (len(s) > 1 and s.endswith(KOREAN_ENDINGS))
        return FUNCTION if s in FUNCTION_WORDS else CONTENT
    if group == "mark":
        return LINK if "href" in s else -1
    return {"hira": KANA + 1, "kata": KANA, "han": KANA, "end": END, "punct": PUNCT, "num": NUMBER, "sep": SEPARATOR, "code": CODE, "link": LINK, "tag": TAG}[group]


def classify(text: str, known: dict | None = None) -> tuple[bytes, bytes, bytes]:
    """Per token of the text: its class (uint8), its length (int32) and the hash of its lower-case form (int64).

    Han letters of a text without kana are words of their own, as there is no telling where words end.
    ``known`` keeps what was found out about tokens, from text to text.
    """
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    kinds, sizes, words = bytearray(), [], []
    text = plain(text)
    alone = bool(_HAN.search(text)) and not _KANA.search(text)
    for m in _TOKEN.finditer(text):
        s = m[0]
        if alone and m.lastgroup == "han":
            kinds.extend([CONTENT] * len(s))
            sizes.extend([1] * len(s))
            words.extend(xxhash.xxh64_intdigest(c) for c in s)
            continue
        found = known.get(s)
        if found is None:
            low = s.lower()
            found = _word_class(m.lastgroup, low), xxhash.xxh64_intdigest(low)
            if len(s) < 40:
                known[s] = found
        if found[0] >= 0:
            kinds.append(found[0])
            sizes.append(len(s))
            words.append(found[1])
    return bytes(kinds), np.array(sizes, np.int32).tobytes(), np.array(words, np.uint64).view(np.int64).tobytes()


def _moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    if n <= width:
        return np.full(n, x.mean()) if n else x
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(n)
    lo, hi = np.maximum(at - width // 2, 0), np.minimum(at + width // 2 + 1, n)
    return (total[hi] - total[lo]) / (hi - lo)


def _contexts(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes two and one before each token; CLASSES stands for the start of a sentence and beyond."""
    one = np.concatenate([[CLASSES], kinds[:-1]]).astype(int)
    one[one == END] = CLASSES
    two = np.concatenate([[CLASSES], one[:-1]])
    two[one == CLASSES] = CLASSES
    return two, one


def _main_script(text: str) -> int:
    """1 + the number of the script with most letters in the whole text; 1 if it has none."""
    found = np.zeros(len(_SCRIPTS), int)
    for letter, n in Counter(text).items():
        if letter not in _LETTERS:
            _LETTERS[letter] = next((i for i, x in enumerate(_SCRIPTS) if x.match(letter)), -1)
        if _LETTERS[letter] >= 0:
            found[_LETTERS[letter]] += n
    return 1 + int(np.argmax(found))


def _language(text: str, kinds: bytes, words: bytes) -> tuple[int, bool]:
    """0, or the number of the main script of a text that lacks known function words; and whether it has sentences nevertheless.

    Sentences, in any language: most words stand between sentence ends, five to sixty at a time and hardly
    one twice in a sentence, with few links, codes, tags and separators, and they don't share their phrases.
    """
    k, w = np.frombuffer(kinds, np.uint8), np.frombuffer(words, np.int64)
    word = _IS_WORD[k]
    n = int(word.sum())
    if n < 8 or _IS_FUNCTION[k].sum() >= FEW_FUNCTION * n:
        return 0, False
    script = _main_script(text)
    end = k == END
    sentence = np.concatenate([[0], np.cumsum(end)[:-1]])
    total = int(end.sum())
    pairs = np.unique(np.stack([sentence[word], w[word]]), axis=1)
    size, different = np.bincount(sentence[word], minlength=total + 1), np.bincount(pairs[0], minlength=total + 1)
    fine = (size >= 5) & (size <= 60) & (different >= 0.7 * size)
    fine[total:] = False  # what no sentence end follows
    if size[fine].sum() < 0.7 * n or _IS_ODD[k].sum() > 0.05 * len(k):
        return script, False
    # Different sentences say different things; the same sentence again counts once.
    said = np.zeros(total + 1, np.uint64)
    np.add.at(said, sentence, w.astype(np.uint64) * (np.uint64(2) * np.arange(len(w), dtype=np.uint64) - np.uint64(2) * np.concatenate([[0], np.nonzero(end)[0] + 1]).astype(np.uint64)[sentence] + np.uint64(1)))
    once = np.isin(sentence, np.unique(said, return_index=True)[1])
    return script, bool(_own_cost(w[once]).mean() >= NEW_WORDS)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict = {}
    for b in batches:
        rows = [classify(t, known) for t in b.text]
        langs = [_language(t, k, w) for t, (k, _, w) in zip(b.text, rows)]
        yield pd.DataFrame(
            {"row": b["row"], "id": b.id, "kinds": [r[0] for r in rows], "sizes": [r[1] for r in rows], "words": [r[2] for r in rows], "script": [x[0] for x in langs], "sentences": [x[1] for x in langs]}
        )


def _script_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often, and in how many texts, each word stands in texts of unknown languages, by script."""
    for b in batches:
        parts = []
        for script, kinds, words in zip(b.script, b.kinds, b.words):
            w, n = np.unique(np.frombuffer(words, np.int64)[_IS_WORD[np.frombuffer(kinds, np.uint8)]], return_counts=True)
            parts.append(pd.DataFrame({"script": script, "word": w, "n": n, "texts": 1}))
        if parts:
            yield pd.concat(parts).groupby(["script", "word"], as_index=False).sum().astype({"script": "int32", "n": "int64", "texts": "int64"})


def _learned(functions: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Makes the learned function words of its script FUNCTION in every text of an unknown language."""
        for b in batches:
            out = []
            for script, kinds, words in zip(b.script, b.kinds, b.words):
                k = np.frombuffer(kinds, np.uint8).copy()
                k[_is_in(np.frombuffer(words, np.int64), functions.get(script, np.array([], np.int64))) & (k == CONTENT)] = FUNCTION
                out.append(k.tobytes())
            yield b.assign(kinds=out)

    return run


def _own_cost(words: np.ndarray) -> np.ndarray:
    """Nats of every token given the one before it, under what the text itself said up to there."""

    def earlier(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x, kind="stable")
        first = np.concatenate([[True], x[order][1:] != x[order][:-1]])
        at = np.arange(len(x))
        out = np.empty(len(x), np.int64)
        out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        return out

    if len(words) < 2:
        return np.full(len(words), 6.0)
    before = words[:-1]
    pair = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words[1:].astype(np.uint64)
    cost = -np.log((earlier(pair) + 0.1) / (earlier(before) + 1))
    return np.concatenate([[6.0], np.minimum(cost, 6.0)])


def _word_use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each content word stands in windows with many function words, and in windows with few."""
    for b in batches:
        keys, prose, listed = [], [], []
        for kinds, words, sentences in zip(b.kinds, b.words, b.sentences):
            k, w = np.frombuffer(kinds, np.uint8), np.frombuffer(words, np.int64)
            keep = _IS_SHOWN[k]
            k, w = k[keep], w[keep]
            if len(k) < 12:
                continue
            share = _moving_mean(_IS_FUNCTION[k].astype(float), WINDOW)
            word = _IS_WORD[k]
            keys.append(w[word])
            prose.append(share[word] >= 0.3)
            listed.append((share[word] < LITTLE_FUNCTION) & (not sentences))
        if keys:
            d = pd.DataFrame({"word": np.concatenate(keys), "prose": np.concatenate(prose), "listed": np.concatenate(listed)})
            yield d.groupby("word", as_index=False).sum().astype("int64")


def _is_in(w: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, w), max(len(ordered) - 1, 0))
    return ordered[at] == w if len(ordered) else np.zeros(len(w), bool)


def _with_listed(kinds: bytes, words: bytes, listed: np.ndarray) -> np.ndarray:
    k = np.frombuffer(kinds, np.uint8).copy()
    known = _is_in(np.frombuffer(words, np.int64), listed)
    k[known & (k == CONTENT)] = LISTED
    k[known & (k == HANGUL)] = HANGUL + 2
    k[known & (k == KANA)] = KANA + 2
    return k


def _own_words(common: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The different words of each text that may be LISTED, without ``common``."""
        for b in batches:
            rows, found = [np.array([], np.int64)], [np.array([], np.int64)]
            for row, kinds, words in zip(b["row"], b.kinds, b.words):
                w = np.unique(np.frombuffer(words, np.int64)[np.isin(np.frombuffer(kinds, np.uint8), [CONTENT, HANGUL, KANA])])
                w = w[~_is_in(w, common)]
                rows.append(np.full(len(w), row, np.int64))
                found.append(w)
            yield pd.DataFrame({"row": np.concatenate(rows), "word": np.concatenate(found)})

    return run


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Classes of each text with the LISTED words that were joined to it."""
    for b in batches:
        own = [np.sort(np.array([] if o is None else o, np.int64)) for o in b.own]
        b["kinds"] = [_with_listed(k, w, o).tobytes() for k, w, o in zip(b.kinds, b.words, own)]
        yield b[["row", "id", "kinds", "sizes", "words", "script", "sentences"]]


def _trigrams(listed: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Class trigrams of sentences that are prose: four to 59 words, function words, hardly a listed word, no link, code or tag."""
        for b in batches:
            counts = np.zeros((CLASSES + 1) ** 2 * CLASSES, np.int64)
            parts = []
            for kinds, words in zip(b.kinds, b.words):
                k = _with_listed(kinds, words, listed)
                if not len(k):
                    continue
                ends = k == END
                sentence = np.concatenate([[0], np.cumsum(ends)[:-1]])
                total = int(ends.sum())
                word, function, some_listed, odd = (np.bincount(sentence, t[k], total + 1)[:total] for t in (_IS_WORD, _IS_FUNCTION, _IS_LISTED, _IS_ODD))
                prose = (word >= 4) & (word < 60) & (function >= 0.3 * word) & (some_listed <= 0.12 * word) & (odd == 0)
                two, one = _contexts(k)
                code = (two * (CLASSES + 1) + one) * CLASSES + k
                parts.append(code[np.append(prose, False)[sentence]])
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=len(counts))
            some = np.nonzero(counts)[0]
            yield pd.DataFrame({"code": some.astype("int64"), "n": counts[some]})

    return run


def _share(listed: np.ndarray, cost: np.ndarray, window: int, high: float, low: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shares, means = [], []
            for kinds, sizes, words, sentences in zip(b.kinds, b.sizes, b.words, b.sentences):
                k = _with_listed(kinds, words, listed)
                size = np.frombuffer(sizes, np.int32)
                if size.sum() < LEAST_CHARS:
                    shares.append(0.0)
                    means.append(0.0)
                    continue
                nats = np.minimum(cost[(*_contexts(k), k)], 6.0)
                means.append(float(nats.mean()))
                if sentences:
                    shares.append(0.0)
                    continue
                function = _moving_mean(_IS_FUNCTION[k].astype(float), window) / np.maximum(_moving_mean(_IS_SHOWN[k].astype(float), window), 1e-9)
                odd = _moving_mean(nats, window) > high
                few = function < LITTLE_FUNCTION
                if (few & ~odd).any():
                    odd |= few & (_moving_mean(_own_cost(np.frombuffer(words, np.int64)), window) < low)
                shares.append(float(size[odd].sum() / size.sum()))
            yield pd.DataFrame({"id": b.id, "share": shares, "nats": means})

    return run


def odd_share(docs: DataFrame, key: str, text: str, window: int = WINDOW, high: float = HIGH, low: float = LOW, local_words: int = LOCAL_WORDS) -> DataFrame:
    """``id, share, nats``: the share of each text (by characters) that is no running language, and its mean cost.

    Texts become sequences of function words and word classes (content words, sentence ends, numbers, links,
    codes, tags, separators; letters of Korean and Japanese have classes of their own). Function words of a few
    languages are given. Those of others are learned, by script, from texts that lack given ones and yet have
    sentences: their frequent words that many texts share. Then two statistics of the whole corpus are learned:
    which content words mostly stand outside of prose, and an n-gram model of the classes in prose sentences.

    A window is no prose if its mean cost under the model (log perplexity) is above ``high``; or if it has hardly a
    function word and its mean cost under the text's own words so far is below ``low``: phrases said over and
    over. A text in sentences of an unknown language has share 0, as the model can't judge its words.

    Defined cases: null, empty and blank texts and short remarks (LEAST_CHARS) have share 0; texts of any length are
    scored whole; repeated rows are repeated. Driver and executors hold the trigram table and, of the
    ``local_words`` most frequent words, the listed ones; nothing that grows with the corpus. Rarer listed words,
    each less than 1 / local_words of all, are joined to the texts.
    """
    col = F.col
    base = docs.select(col(key).alias("id"), col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"row bigint, id {kind}, kinds binary, sizes binary, words binary, script int, sentences boolean"
    tokens = cut(base.where("text is not null").withColumn("row", F.monotonically_increasing_id()).mapInPandas(_tokens, schema))
    foreign = tokens.where("script > 0")
    counted = foreign.where("sentences").mapInPandas(_script_words, "script int, word bigint, n bigint, texts bigint").groupBy("script", "word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counted = cut(counted)
    of = {r["script"]: r["n"] for r in counted.groupBy("script").agg(F.sum("n").alias("n")).collect()}  # a row per script
    functions = {}
    for script, n in of.items():
        # Each is more than LEARNED_SHARE of all words, so there are no more than 1 / LEARNED_SHARE.
        often = counted.where((col("script") == script) & (col("n") >= LEARNED_SHARE * n) & (col("texts") >= LEARNED_TEXTS) & (col("n") <= LEARNED_MOST * col("texts")))
        functions[script] = np.sort(often.select("word").toPandas()["word"].to_numpy(np.int64))
    if any(map(len, functions.values())):
        tokens = tokens.where("script = 0").unionByName(foreign.mapInPandas(_learned(functions), schema))
    use = cut(tokens.mapInPandas(_word_use, "word bigint, prose bigint, listed bigint").groupBy("word").agg(F.sum("prose").alias("p"), F.sum("listed").alias("l")))
    total = use.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    ratio = F.log(((col("l") + 0.5) / (total.l + 1)) / ((col("p") + 0.5) / (total.p + 1)))
    often = use.withColumn("is_listed", (col("l") >= LISTED_TIMES) & (ratio > LISTED_NATS))
    words = lambda df: np.sort(df.select("word").toPandas()["word"].to_numpy(np.int64))
    all_listed = often.where("is_listed")
    if all_listed.count() <= local_words:
        listed = words(all_listed)
    else:
        common = cut(often.orderBy((col("p") + col("l")).desc(), "word").limit(local_words))
        listed = words(common.where("is_listed"))
        rare = all_listed.join(F.broadcast(common.select("word")), "word", "left_anti").select("word")
        own = tokens.mapInPandas(_own_words(words(common)), "row bigint, word bigint").join(rare, "word").groupBy("row").agg(F.collect_list("word").alias("own"))
        tokens = cut(tokens.join(own, "row", "left").mapInPandas(_mark, schema))
    counts = np.full((CLASSES + 1) ** 2 * CLASSES, 0.3)
    for code, n in tokens.mapInPandas(_trigrams(listed), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[code] += n
    counts = counts.reshape(CLASSES + 1, CLASSES + 1, CLASSES)
    cost = -np.log(counts / counts.sum(2, keepdims=True))
    scored = tokens.mapInPandas(_share(listed, cost, window, high, low), f"id {kind}, share double, nats double")
    return scored.unionByName(base.where("text is null").select("id", F.lit(0.0).alias("share"), F.lit(0.0).alias("nats")))


def odd_texts(docs: DataFrame, key: str, text: str, most: float = 0.5) -> DataFrame:
    """``id`` of the texts of which more than ``most`` is no running language."""
    return odd_share(docs, key, text).where(F.col("share") > most).select("id")
