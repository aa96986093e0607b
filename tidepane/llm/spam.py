"""Mails that are keyword mass, link lists or product tags instead of sentences.

Each text part is judged by its own content (see ``mailtext``). Its lines and
clauses are told apart: data (logs, tables, code, orders), links, product tags,
hashtags, and clauses with their share of function words. Clauses with too few
function words are keyword mass; no word of them is left out of the counts.

What is too few, too repetitive or too dense is not fixed: one pass over all
documents writes the features of every part, and the thresholds of each language
are quantiles of its mails of sentences (:func:`calibrated`), whatever the size
of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.llm.mailtext import LINK_CLOSE, LINK_OPEN, markup_text, own_lines, repaired, text_parts
from tidepane.session import written

# Function words (articles, pronouns, prepositions, conjunctions, auxiliary and modal verbs, particles) of the corpus languages (fixed values).
FUNCTION_WORDS = {
    "en": "a an the and or but nor so if because although though while when whenever where wherever until unless since than that whether as of to in on at by for from with without within about above across after against along among around before behind below beneath beside between beyond during inside into near off onto out outside over past through throughout toward towards under up upon via down i you he she it we they me him her us them my your his its our their mine yours hers ours theirs myself yourself himself herself itself ourselves themselves this these those who whom whose which what how why there here all any both each every either neither few many more most much no none not only other others another own same some such very too also just even still yet then now once again ever never always be am is are was were been being have has had having do does did doing will would shall should can could may might must please",
    "de": "der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner keines und oder aber denn sondern doch weil dass daß ob wenn als wie während damit obwohl bevor nachdem sobald falls deshalb deswegen daher darum also jedoch trotzdem dann da in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter um für gegen ohne durch bis seit wegen trotz zwischen neben hinter ich du er sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen sich man mein meine meinen meinem meiner dein deine sein seine seinen seinem seiner unser unsere unseren unserem unserer euer eure ihre ihren ihrem ihrer dieser diese dieses diesen diesem jener jene jenes jeder jede jedes jeden jedem welcher welche welches wer was wen wem wessen wo wann warum wieso woher wohin hier dort nicht nur auch noch schon sehr mehr so zu bin bist ist sind seid war waren wäre wären gewesen habe hast hat haben habt hatte hatten hätte hätten werde wirst wird werden wurde wurden würde würden kann kannst können konnte konnten könnte könnten muss müssen musste mussten müsste soll sollen sollte sollten will wollen wollte wollten darf dürfen durfte dürfte mag mögen möchte möchten bitte",
    "fr": "le la les l' un une des de du d' au aux et ou mais ni car donc or que qu' qui quoi dont où quand comme si lorsque puisque parce afin ainsi alors aussi à dans en par pour sur sous avec sans vers chez entre depuis pendant avant après contre dès jusque selon devant derrière je j' tu il elle on nous vous ils elles me m' te t' se s' lui leur y moi toi eux mon ma mes ton ta tes son sa ses notre nos votre vos leurs ce c' cet cette ces cela ça celui celle ceux celles quel quelle quels quelles tout toute tous toutes même autre autres chaque quelque quelques aucun aucune ne n' pas plus moins très trop peu bien encore déjà toujours jamais ici là suis es est sommes êtes sont étais était étions étaient sera seront serait soit soient été être ai as a avons avez ont avais avait avions avaient aura auront aurait ait eu avoir peut peuvent pouvait pourrait doit doivent devait devrait faut",
    "es": "el la los las lo un una unos unas de del a al y e o u pero sino ni que porque pues si cuando como donde mientras aunque para por en con sin sobre bajo entre hasta desde hacia según contra ante tras durante yo tú él ella ello usted nosotros nosotras vosotros ellos ellas ustedes me te se nos os le les mi mis tu tus su sus nuestro nuestra nuestros nuestras vuestro este esta esto estos estas ese esa eso esos esas aquel aquella aquellos aquellas quien quienes cual cuales cuyo qué quién cuál cuándo cómo dónde cada todo toda todos todas otro otra otros otras mismo misma algún alguna algunos algunas ningún ninguna no sí más menos muy tan ya también tampoco aún todavía siempre nunca aquí allí soy eres es somos son era eran fue fueron ser será sería sea sean siendo sido estoy está estamos están estaba estaban estado he has ha hemos han había habían haber habrá hay puede pueden podía podría debe deben debía debería",
    "ru": "и а но или да либо что чтобы как когда если пока хотя потому поэтому так также тоже же ли бы не ни в во на с со к ко у о об обо от ото из изо за до по под над при про для без через между перед после около среди против вместо кроме я ты он она оно мы вы они меня тебя его её ее нас вас их мне тебе ему ей нам вам им мной тобой нами вами ними нём нем ней себя себе собой мой моя моё мое мои твой твоя наш наша наше наши нашей нашего вашу ваш ваша ваше ваши свой своя свои этот эта это эти этой этого этом этих тот та то те того той тех такой такая такие который которая которое которые которых кто чем чего чему где куда откуда почему сколько какой какая какое какие весь вся всё все всех сам сама сами каждый другой ещё еще уже только лишь даже очень более здесь там тут сейчас теперь потом есть был была было были будет будут быть может могут можно нужно надо нельзя пожалуйста",
}
_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _LANGUAGES_OF[_word] = (*_LANGUAGES_OF.get(_word, ()), _language)

#: Shares of function words at which a clause may count as a sentence; calibration picks one for each language.
LEVELS = (0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.225, 0.25)
#: Parts without function words are of no known language.
UNKNOWN = "und"


@dataclass(frozen=True)
class SpamLimits:
    """How thresholds follow from the mails of sentences of a language, and what they are where there are no mails."""

    #: Share of a language's usual share of function words from which a clause is a sentence.
    sentence_part: float = 0.36
    #: Mails of sentences: at least so many words in sentences, at most this share of keyword mass.
    sentence_words: int = 20
    bulk_mass: float = 0.5
    #: Word shares of parts with fewer content words say nothing.
    content_words: int = 25
    #: A feature is unusual if it is so many times as far from the median of the mails of sentences as their
    #: ``quantile`` is. Less than 1 - quantile of wrong ones among them can not move a threshold far.
    quantile: float = 0.9
    times: float = 3.0
    #: Words in sentences for each link, as a part of what all but 1 - quantile of the mails of sentences have.
    link_part: float = 1 / 3
    #: Keyword words, and their share among all words of clauses, from which a part can be keyword mass.
    min_mass: int = 15
    mass_share: float = 0.35
    most_distinct: float = 0.8  # more distinct words than this are never keyword mass
    unspaced_distinct: float = 0.85  # the same in a script without spaces, where joined words hide repetition
    min_links: int = 5
    min_tags: int = 8  # hashtags, product lines, or entries after "tags:"
    words_per_tag: float = 5.0
    min_clauses: int = 16  # repetition of clauses
    phrase_mass: float = 0.05  # keyword mass of a part whose sentences are made of keywords, if it has as many function words as usual
    #: Mails of sentences whose weight the values below have (those of all languages together have it within a language).
    prior_weight: float = 200.0
    function_share: float = 0.42
    top: float = 0.35  # three most frequent words among the words
    distinct: float = 0.45  # distinct words among the words
    pair: float = 0.15  # most frequent pair of neighbouring words
    separator: float = 0.45  # separators for each word
    repeated: float = 0.5  # repeated clauses among clauses, at least
    link_words: float = 4.6


# Words that mark a disclaimer, in lower case (fixed values).
DISCLAIMER_WORDS = (
    "addressee", "intended recipient", "confidential", "accepts no liability", "before printing", "vertraulich", "für den empfänger bestimmt", "réservé à son destinataire",
    "confidentiel", "destinatario", "confidencial", "предназначено только адресату", "конфиденциальн", "宛先の方のみ", "機密",
)
#: A disclaimer is looked for among so many last paragraphs.
LAST_PARAGRAPHS = 4
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
# Cyrillic letters that look like Latin ones, and signs that stand for letters (fixed values).
_LOOKALIKE = str.maketrans("асеорхуіјѕԁһӏԛԝАВЕКМНОРСТХУ", "aceopxyijsdhlqwABEKMHOPCTXY")
_SIGNS = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"\w*(?:[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z])\w*")
_SIGNED = re.compile(r"(?<![\w@$/.:-])(?=[\w@$]*[^\W\d_])(?=[\w@$]*[0-9@$])[\w@$]{2,}(?![\w@$/:-])")
_SPACED = re.compile(r"(?<!\w)\w(?:([ .\-_*])\w)(?:\1\w){2,}(?!\w)")
_DOT_WORD = re.compile(r"\s+[\[(]?dot[\])]?\s+", re.I)
_URL = re.compile(r"(?:(?:https?|ftp)://|www\.)[^\s<>\"]+|(?<![\w@.-])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,18}(?:[/?][^\s<>\"]*|(?=\s*$))", re.I | re.M)
_FOOTNOTE = re.compile(r"^\s*\[\d+\]:?\s*\S+\s*$", re.M)
_HASHTAG = re.compile(r"#\w{3,}")
#: A word; compounds with hyphens are one, elided articles and pronouns are words of their own.
_WORD = re.compile(r"(?:[cdjlmnst]|qu)'|[^\W\d_]+(?:-[^\W\d_]+)*", re.I)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CJK_WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W\d_]+")
_PARTICLE = re.compile(r"です|ます|ました|ません|ください|ため|でした|した|ない|[をはがにのでともへ]")
_PRODUCT = re.compile(r"^\s*[A-Z]{1,4}-?\d{3,7}\b.*\d[.,]\d{2}\s*$")
_TAG_LIST = re.compile(r"^\s*(?:tags?|keywords?|labels?|stichw[oö]rter|schlagw[oö]rter|mots-clés|etiquetas|теги|метки|タグ|キーワード)\s*[:：]\s*(.*)$", re.I | re.S)
#: Numbers that stand alone, and signs of code, logs and markup; separators of lists are not among them.
_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")
_STRUCTURE = re.compile(r"[{}()=\\#$%&+_@\t/:]")
_MAYBE_DATA = re.compile(r"[\d{}()=\\#$%&+_@\t/:]")
#: A line with at most so many words for each of its numbers and signs is data, unless it has enough words to be keyword mass itself.
WORDS_PER_SIGN = 1.5
DATA_WORDS = 14
_MAYBE_LINK = re.compile(r"://|\.\w")
_SIGN = re.compile(r"[0-9@$]")
_SEPARATOR = re.compile(r"[,;|·~*、•>\]]|\.\.\.")
_CLAUSE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_PARAGRAPH = re.compile(r"\n\s*\n")
#: Lines under so many characters can be entries of a list.
SHORT_LINE = 60


def plain_letters(text: str) -> str:
    """Text with the usual disguises undone: invisible characters, look-alike letters, s p a c e d words, broken links."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    text = text.replace("[.]", ".").replace("(.)", ".")
    if "xxp" in text.lower():
        text = re.sub(r"\bhxxp", "http", text, flags=re.I)
    if "dot" in text:
        text = _DOT_WORD.sub(".", text)
    if not text.isascii():
        text = _MIXED.sub(lambda m: m[0].translate(_LOOKALIKE), text)
    return _SPACED.sub(lambda m: m[0].replace(m[1], ""), text)


def is_data(line: str) -> bool:
    """A line of a log, a table or code: about as many numbers and signs as words."""
    if not _MAYBE_DATA.search(line):
        return False
    signs = len(_NUMBER.findall(line)) + len(_STRUCTURE.findall(line))
    return signs > 0 and len(_WORD.findall(line)) <= min(DATA_WORDS, WORDS_PER_SIGN * signs)


def is_disclaimer(paragraph: str) -> bool:
    low = paragraph.lower()
    return any(w in low for w in DISCLAIMER_WORDS)


def function_shares(words: list[str]) -> dict[str, int]:
    """Function words among ``words`` per language."""
    found: dict[str, int] = {}
    for w in words:
        for language in _LANGUAGES_OF.get(w, ()):
            found[language] = found.get(language, 0) + 1
    return found


def repetition(runs: Iterable[list[str]]) -> tuple[int, float, float, float]:
    """Words in runs (pairs do not go across): their number, the shares of the three most frequent, of distinct ones, and of the most frequent pair."""
    words: list[str] = []
    pairs: list[tuple[str, str]] = []
    for run in runs:
        words += run
        pairs += zip(run, run[1:])
    n = len(words)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = Counter(words)
    most = max(Counter(pairs).values(), default=0)
    # A pair that came twice may be chance.
    return n, sum(sorted(counts.values())[-3:]) / n, len(counts) / n, most / len(pairs) if most > 2 else 0.0


@dataclass
class Clause:
    level: int  # how many of LEVELS its share of function words reaches
    text: str
    words: list[str]
    weight: int  # words it stands for as a sentence
    unspaced: int  # words in a script without spaces
    counts: bool  # whether it counts as a sentence if it is one; in a disclaimer it does not


def _level(share: float) -> int:
    return sum(share >= x for x in LEVELS)


def _clauses(unit: str, counts: bool, functions: Counter, seen: Counter) -> Iterator[Clause]:
    for clause in _CLAUSE.split(unit):
        if clause.strip():
            seen[clause.strip().lower()] += 1
        cjk = 0 if clause.isascii() else len(_CJK.findall(clause))
        if cjk >= 4:
            words = [w.lower() for w in _CJK_WORD.findall(clause)]
            particles = len(_PARTICLE.findall(clause)) if cjk >= 8 else 0
            functions["ja"] += particles
            functions[""] += cjk // 2
            level = _level(particles / (cjk // 2)) if particles > 1 else 0
            yield Clause(level, clause, words, cjk // 2, sum(not w.isascii() for w in words), counts)
            continue
        if _SIGN.search(clause):
            clause = _SIGNED.sub(lambda x: x[0].lower().translate(_SIGNS), clause)
        words = _WORD.findall(clause.lower().replace("\u2019", "'"))
        if words:
            found = function_shares(words)
            functions.update(found)
            functions[""] += len(words)
            level = _level(max(found.values(), default=0) / len(words)) if len(words) > 2 else 0
            yield Clause(level, clause, words, len(words), 0, counts)


def features(own: str) -> dict:
    """Features of the own content of a part; ``cuts`` has those of its keyword mass for each of LEVELS."""
    text = plain_letters(_FOOTNOTE.sub("", own) if "[" in own else own)
    links = text.count(LINK_OPEN)
    text = text.replace(LINK_OPEN, " ").replace(LINK_CLOSE, " ")
    if _MAYBE_LINK.search(text):
        text, found = _URL.subn(" ", text)
        links += found
    hashtags = products = entries = 0
    if "#" in text:
        text, hashtags = _HASHTAG.subn(" ", text)
    functions: Counter = Counter()
    clauses: list[Clause] = []
    seen: Counter = Counter()
    paragraphs = [p for p in _PARAGRAPH.split(text) if p.strip()]
    for at, paragraph in enumerate(paragraphs):
        counts = at < len(paragraphs) - LAST_PARAGRAPHS or not is_disclaimer(paragraph)
        tags = _TAG_LIST.match(paragraph)
        if tags:
            entries = max(entries, len([x for x in re.split(r"[,;、|/·\n]", tags[1]) if x.strip()]))
        kept = []
        for line in paragraph.split("\n"):
            if line.rstrip()[-1:].isdigit() and _PRODUCT.match(line):
                products += 1
            elif line.strip() and not is_data(line):
                kept.append(line)
        listed = len(kept) > 3 and sum(len(x) < SHORT_LINE for x in kept) > 0.6 * len(kept)
        for unit in kept if listed else [" ".join(kept)]:
            clauses += _clauses(unit, counts, functions, seen)
    total = functions.pop("", 0)
    language, most = max(functions.items(), key=lambda x: (x[1], x[0]), default=(UNKNOWN, 0))
    n, top, distinct, pair = repetition([w for w in c.words if w not in _LANGUAGES_OF] for c in clauses)
    units = seen.total()
    return {
        "language": language if most else UNKNOWN, "words": total, "function_share": most / total if total else 0.0, "links": links, "tags": max(hashtags, products, entries),
        "clauses": units, "repeated": 1 - len(seen) / units if units else 0.0, "n": n, "top": top, "distinct": distinct, "pair": pair, "cuts": _cuts(clauses),
    }


def _cuts(clauses: list[Clause]) -> list[dict]:
    """For each level, the keyword mass of the clauses below it and the words of the sentences at or above it."""
    out: list[dict] = []
    mass: list[Clause] = []
    sentences, separators, unspaced = sum(c.weight for c in clauses if c.counts), 0, 0
    for level in range(len(LEVELS)):
        joining = [c for c in clauses if c.level == level]
        if out and not joining:
            out.append(out[-1])
            continue
        for c in joining:
            mass.append(c)
            separators += len(_SEPARATOR.findall(c.text))
            unspaced += c.unspaced
            sentences -= c.weight if c.counts else 0
        n, top, distinct, pair = repetition(c.words for c in mass)
        out.append({"sentence_words": sentences, "mass": n, "top": top, "distinct": distinct, "pair": pair, "separators": separators / n if n else 0.0, "unspaced": unspaced / n if n else 0.0})
    return out


def word_features(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repetition in each text as it stands: ``key``, ``words``, ``top``, ``distinct`` and ``pair`` (see :func:`repetition`),
    ``function_words`` (of the language with most of them) and ``separators``; 0 for null and empty texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(1):
                body = body.as_py() or ""
                words = _WORD.findall(body.lower())
                rows.append((*repetition([words]), max(function_shares(words).values(), default=0), len(_SEPARATOR.findall(body))))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "words", "top", "distinct", "pair", "function_words", "separators"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInArrow(read, f"`{key}` {kind}, words int, top double, distinct double, pair double, function_words int, separators int")


_CUT = "struct<sentence_words: int, mass: int, top: double, distinct: double, pair: double, separators: double, unspaced: double>"
_FEATURES = f"language string, words int, function_share double, links int, tags int, clauses int, repeated double, n int, top double, distinct double, pair double, cuts array<{_CUT}>"


def message_features(message: str | None) -> Iterator[dict]:
    """Features of each text part of a raw mail; none for null and empty texts."""
    for kind, body in text_parts(message) if message else ():
        body = repaired(body)
        yield features("\n".join(own_lines(markup_text(body) if kind == "html" else body)))


def part_features(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the features of each text part of each document; the whole text is read, nothing is shuffled."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(_FEATURES).fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, message in enumerate(batch.column(1)):
                for f in message_features(message.as_py()):
                    at.append(i)
                    rows.append(f)
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, *(name for name, _ in kinds)])

    return documents.select(key, text).mapInArrow(read, f"`{key}` {dict(documents.dtypes)[key]}, {_FEATURES}")


def _at(q: float, value: Column, where: Column, digits: int = 3) -> Column:
    """Exact quantile of values rounded to few digits, so that an aggregation holds few different ones."""
    return F.percentile(F.when(where, F.round(value, digits)), F.lit(q))


#: Features that are calibrated, in the order of the priors of SpamLimits.
CALIBRATED = ("top", "distinct", "pair", "separator", "repeated", "link_words")


def _shrunk(parts: DataFrame, estimates: dict[str, Column], numbers: dict[str, Column], limits: SpamLimits) -> dict[str, dict[str, float]]:
    """For each language its estimates, drawn to those of all languages, which are drawn to the priors.

    The weight of a draw is ``prior_weight`` mails, so few mails change little
    and the rule is the same for any number of them.
    """
    asked = [e.alias(f"{k}_e") for k, e in estimates.items()] + [n.alias(f"{k}_n") for k, n in numbers.items()]
    both = parts.groupBy("language").agg(*asked).unionByName(parts.agg(F.lit(None).cast("string").alias("language"), *asked))
    rows = {r["language"]: r for r in both.collect()}  # a row per language of FUNCTION_WORDS, Japanese, and two more

    def drawn(row, k: str, to: float) -> float:
        n, w = (row[f"{k}_n"], limits.prior_weight) if row else (0, 1.0)
        return float((n * (row[f"{k}_e"] or 0.0 if n else 0.0) + w * to) / (n + w))

    overall = {k: drawn(rows[None], k, getattr(limits, k)) for k in estimates}
    return {language: {k: drawn(rows.get(language), k, overall[k]) for k in estimates} for language in (*FUNCTION_WORDS, "ja")}


def _table(parts: DataFrame, values: dict[str, dict[str, float]], names: Iterable[str]) -> DataFrame:
    """One row per language."""
    names = list(names)
    return parts.sparkSession.createDataFrame([(language, *(row[k] for k in names)) for language, row in values.items()], "language string, " + ", ".join(f"`{k}` double" for k in names))


def at_cut(parts: DataFrame, limits: SpamLimits = SpamLimits()) -> DataFrame:
    """Parts with ``mass_``... features at the share of function words from which a clause of their language is a sentence.

    That share is the part ``sentence_part`` of the language's usual (median)
    share of function words, rounded down to one of LEVELS. A part whose own
    share is lower is in no known language.
    """
    known = (F.col("language") != UNKNOWN) & (F.col("words") >= limits.sentence_words)
    usual = _shrunk(parts, {"function_share": _at(0.5, F.col("function_share"), known)}, {"function_share": F.count(F.when(known, 1))}, limits)
    level = F.greatest(sum((F.col("function_share") * limits.sentence_part >= x).cast("int") for x in LEVELS), F.lit(1))
    usual[UNKNOWN] = {"function_share": min(x["function_share"] for x in usual.values())}
    levels = _table(parts, usual, ["function_share"]).select("language", F.col("function_share").alias("usual"), level.alias("level"))
    # One row per language.
    laid = parts.join(F.broadcast(levels), "language").withColumn("cut", F.element_at("cuts", F.col("level")))
    spoken = F.col("function_share") >= F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level"))
    laid = laid.withColumn("language", F.when(spoken, F.col("language")).otherwise(F.lit(UNKNOWN)))
    return laid.select("*", "cut.sentence_words", "cut.mass", F.col("cut.top").alias("mass_top"), F.col("cut.distinct").alias("mass_distinct"), F.col("cut.pair").alias("mass_pair"), F.col("cut.separators").alias("separators"), F.col("cut.unspaced").alias("unspaced")).drop("cut", "cuts", "level")


def _unusual(value: Column, where: Column, limits: SpamLimits, digits: int = 3) -> Column:
    """Upper threshold: the median and ``times`` its distance to the quantile."""
    usual = _at(0.5, value, where, digits)
    return usual + (_at(limits.quantile, value, where, digits) - usual) * limits.times


def _unusually_low(value: Column, where: Column, limits: SpamLimits, digits: int = 3) -> Column:
    """Lower threshold of a positive feature: the same on a logarithmic scale."""
    usual = _at(0.5, value, where, digits)
    return usual * F.pow(_at(1 - limits.quantile, value, where, digits) / usual, F.lit(limits.times))


def calibrated(parts: DataFrame, limits: SpamLimits = SpamLimits()) -> DataFrame:
    """Thresholds per language (the columns of CALIBRATED) from its mails of sentences, over all parts of :func:`at_cut`."""
    bulk = (F.col("sentence_words") >= limits.sentence_words) & (F.col("mass") <= limits.bulk_mass * (F.col("mass") + F.col("sentence_words")))
    worded = bulk & (F.col("n") >= limits.content_words)
    massed = bulk & (F.col("mass") >= limits.min_tags)
    linked = bulk & (F.col("links") >= limits.min_links)
    listed = bulk & (F.col("clauses") >= limits.min_clauses)
    low = 1 - limits.quantile
    estimates = {
        "top": _unusual(F.col("top"), worded, limits),
        "distinct": _unusually_low(F.col("distinct"), worded, limits),
        "pair": _unusual(F.col("pair"), worded, limits),
        "separator": _unusual(F.col("separators"), massed, limits),
        "repeated": _unusual(F.col("repeated"), listed, limits),
        "link_words": _at(low, F.least(F.col("sentence_words") / F.col("links"), F.lit(1000)), linked, 1) * limits.link_part,
    }
    numbers = dict(zip(CALIBRATED, (worded, worded, worded, massed, listed, linked), strict=True))
    found = _shrunk(parts, estimates, {k: F.count(F.when(c, 1)) for k, c in numbers.items()}, limits)
    # What lacks the function words of every language needs no more repetition than the least that is unusual in one.
    found[UNKNOWN] = {k: (max if k in ("distinct", "link_words") else min)(row[k] for row in found.values()) for k in CALIBRATED}
    return _table(parts, found, CALIBRATED)


def verdict(limits: SpamLimits = SpamLimits()) -> Column:
    """``tags``, ``links``, ``keywords`` or ``phrases`` for a part with its language's thresholds (``t``), or null."""
    c, t = F.col, lambda k: F.col(f"t.{k}")
    enough = (c("mass") >= limits.min_mass) & (c("mass") >= limits.mass_share * (c("mass") + c("sentence_words")))
    repeated = (c("mass_top") >= t("top")) | (c("mass_distinct") <= t("distinct")) | (c("mass_pair") >= t("pair")) | ((c("separators") >= t("separator")) & (c("mass_distinct") <= (1 + t("distinct")) / 2))
    repeated = F.when(c("unspaced") >= 0.5, c("mass_distinct") <= limits.unspaced_distinct).otherwise((c("mass_distinct") <= limits.most_distinct) & repeated)
    again = (c("clauses") >= limits.min_clauses) & (c("repeated") >= F.greatest(t("repeated"), F.lit(limits.repeated)))
    # Sentences with fewer function words than usual, with some mass between them, or with hardly any other word.
    made_of_keywords = (c("function_share") < c("usual")) | (c("mass") >= limits.phrase_mass * (c("mass") + c("sentence_words"))) | (c("top") >= (1 + t("top")) / 2)
    full = (c("n") >= limits.min_mass) & (c("top") >= t("top"))
    return (
        F.when((c("tags") >= limits.min_tags) & (c("sentence_words") <= limits.words_per_tag * c("tags")), "tags")
        .when((c("links") >= limits.min_links) & (c("sentence_words") <= t("link_words") * c("links")), "links")
        .when(enough & (repeated | again) | full & again, "keywords")
        .when(full & (c("distinct") <= t("distinct")) & made_of_keywords, "phrases")
    )


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", limits: SpamLimits = SpamLimits()) -> DataFrame:
    """Spam documents: ``key`` and ``kind``, a row per input row that is spam.

    The features of all parts are written once, thresholds are calibrated on all
    of them, and each part is judged by those of its language. A document is spam
    if a part is; its kind is the first in the alphabet. A mail archived twice
    appears under both keys, and a repeated or null key with each of its rows.
    Null and empty texts are no spam.
    """
    # A row may have several parts; the number of the row keeps rows with equal keys apart.
    parts = written(part_features(documents.withColumn("__row", F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("id"))), "__row", text), "features")
    cut = at_cut(parts, limits)
    limit = calibrated(cut, limits)
    # One row per language.
    judged = cut.join(F.broadcast(limit.select("language", F.struct(*CALIBRATED).alias("t"))), "language").withColumn("kind", verdict(limits)).where(F.col("kind").isNotNull())
    return judged.groupBy("__row").agg(F.min("kind").alias("kind")).select(F.col("__row.key").alias(key), "kind")
