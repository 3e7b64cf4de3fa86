"""Problem 4: prompts and responses that do not belong together or are broken, with every defect a record has.

Ordered rules look at the answer and the explanation apart, over Arrow batches.  What a word is, and after which
words more must follow, is counted over the whole bank; only the last words of texts without a stop meet that
vocabulary, in a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut_lineage, spread

#: What stands for "nothing here", without punctuation and in lower case.
NOTHING = (
    "n a", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "todo", "no answer", "no answer given", "not given", "not available", "not applicable", "not provided", "unknown", "blank", "empty", "missing",
    "undefined", "answer", "explanation", "no explanation", "left blank", "nothing", "sin respuesta", "ninguna", "s o", "sans objet", "néant", "aucune", "pas de réponse", "keine angabe", "k a", "entfällt", "keine antwort", "sem resposta", "нет", "нет ответа", "无",
)
#: Words of everyday grammar, by which a language is told.
COMMON = {
    "en": "the of and to in is that which because by with for from only when after neither nor it an through without each on was were are be so as at under this these has its here both what how why who where would",
    "es": "el la los las de que y en según cuando porque por con sin solo si ni se del una un también además pero más cada tras después para cuál qué su ya no es al lo como durante desde sobre en",
    "fr": "le la les de des que et en selon quand parce pour avec sans si ni se du une un aussi plus mais cela chaque après dans pourquoi quelle quel son ne pas est au l d on lorsque pendant depuis sur tous seulement",
    "de": "der die das den dem des und in laut wenn weil für mit ohne nur falls sich von ein eine einen auch aber dass nach seit warum welche welcher nicht ist im am außerdem während vor bei mal was man alle zu zur zum vom",
    "pt": "o a os as de que e em segundo quando porque por com sem somente se nem do da dos das uma um também além mas cada após depois para qual não é ao como durante desde antes no na pela pelo já mais isso nas nos",
}
#: After these words, of the languages above, a text cannot end.
OPEN_WORDS = (
    "the a an of and or to in by with for from that which because when while nor into at than whose as is are was were be the's between although unless if "
    "el la los las de del que y en según cuando porque por con sin si ni un una unos para al como "
    "le les des du et selon quand parce pour avec sans ou au aux une lorsque "
    "der die das den dem des und oder laut wenn weil für mit ohne falls von vom zur zum ein eine einen einem einer dass im am bei seit nach "
    "o os as e em segundo com sem se nem do da dos das uma um ao aos no na nos nas pela pelo"
).split()
#: Names of languages in a question that asks for one.
NAMES = {
    "en": "english|inglés|inglesa?|anglais|englisch\\w*|inglês|английск\\w*|英语|英文",
    "es": "spanish|español\\w*|espagnol\\w*|spanisch\\w*|espanhol\\w*|castellano|испанск\\w*|西班牙语",
    "fr": "french|francés|francesa?|français\\w*|französisch\\w*|francês|французск\\w*|法语",
    "de": "german|alemán|alemana?|allemand\\w*|deutsch\\w*|alemão|alemã|немецк\\w*|德语",
    "pt": "portuguese|portugués|portuguesa?|portugais\\w*|portugiesisch\\w*|português|португальск\\w*|葡萄牙语",
    "ru": "russian|ruso|rusa|russe|russisch\\w*|russo|russa|русск\\w*|俄语",
    "zh": "chinese|chino|china|chinois\\w*|chinesisch\\w*|chinês|chinesa|китайск\\w*|中文|汉语",
}
#: Ways in which someone declines, in several languages; the first person or the request itself must be named.
REFUSALS = (
    r"\b(i|we)( am|'m| are|'re)( very| so| really)? (sorry|afraid|unable|not (able|in a position|allowed|permitted|comfortable|willing|going to))\b",
    r"\b(i|we)( must| have to| will| would| do| should)?( respectfully| regretfully| also)? (cannot|can not|can't|could not|couldn't|won't|will not|decline|refuse|rather not|prefer not|not feel comfortable|don't feel comfortable|don't have (access|enough)|not have (access|enough)|not wish|don't wish|'d rather not)\b",
    r"\bi'd rather not\b|\bi'll have to (decline|pass)\b|\bi would rather not\b|\brather not (answer|discuss|say)\b|\bmy apologies\b|^(apologies|regrettably|unfortunately|sorry)\b.{0,30}\b(i|we|this|that)\b",
    r"\bas an? (ai|artificial|large language|language) |\bthe assistant\b.{0,20}\b(cannot|can't|declin\w+|refus\w+|unable|not|won't)\b",
    r"\b(this|the|your) (request|prompt|content|query)( \w+){0,3} (was|is|has been|had to be|can't be|cannot be|can not be|could not be|couldn't be|won't be|will not be) (declined|refused|generated|produced|provided|blocked|rejected|answered|fulfilled|completed|processed|denied|created)",
    r"\bno (answer|explanation|content|response) (can|could|will|may) be (produced|given|provided|generated|offered)\b|\bagainst (my|our|the) (guidelines|policy|policies|rules|principles)\b|\bnot be appropriate for (me|us)\b|\bnot (something|a topic|able) i (can|am)\b",
    r"\bno (puedo|podemos)\b|\bno me (es|resulta) posible\b|\blo (siento|lamento)\b|\bprefiero no\b|\bno (estoy|soy) (en condiciones|capaz|autorizad[oa])\b|\bcomo (un )?modelo de lenguaje\b|\bno tengo acceso\b|\bme niego\b|\bdisculp[ea]\b|\bcomo (una )?ia\b|\bno estoy en\b",
    r"\bje ne (peux|puis|suis|saurais|souhaite|dispose)\b|\bje (suis )?désolée?\b|^désolée?\b|\bje préfère ne\b|\ben tant que? (modèle|ia|intelligence|qu'ia|qu'intelligence)\b|\ben tant qu'\s?(ia|intelligence)\b|\bje n'ai pas (accès|le droit)\b|\bil m'est impossible\b|\bje refuse\b|\bje regrette\b|\bje m'excuse\b",
    r"\bich (kann|darf|möchte|will|werde|muss)\b.{0,40}\b(nicht|keine?n?|ablehnen|leider)\b|\btut mir leid\b|\bals (ki|ein sprachmodell|sprachmodell|künstliche)\b|\bich bin nicht\b|\bleider (kann|ist es mir|darf|bin) \b|\bes ist mir nicht möglich\b|\bmir ist (es )?nicht\b|\bich habe keinen zugriff\b|\bentschuldigung\b|\b(kann|darf|möchte) ich\b.{0,40}\b(nicht|keine?n?)\b",
    r"\bnão (posso|consigo|podemos|me é possível|estou em|tenho acesso|sou capaz|estou autorizad[oa])\b|\bdesculpe\b|\bsinto muito\b|\blamento\b|\bcomo (um )?modelo de linguagem\b|\bprefiro não\b|\binfelizmente\b.{0,20}\bnão\b|\brecuso\b",
    r"(?<!\pL)(я|мы) не (могу|можем|смогу|имею|готов)|(?<!\pL)извините|к сожалению|(?<!\pL)простите|как языковая модель|не имею доступа",
    r"抱歉|对不起|我无法|我不能|无法回答|作为.{0,12}(模型|人工智能)|不便回答",
)
#: Each way of declining holds one of these words, or letters of another script; spares the long pattern most texts.
DECLINING = (
    "i we my our me us rather apologies regrettably unfortunately sorry ai artificial language assistant request prompt content query answer explanation response against something topic able "
    "puedo podemos posible siento lamento prefiero estoy soy modelo acceso niego disculpa disculpe ia je désolé désolée tant impossible ich leid ki sprachmodell künstliche leider mir entschuldigung não desculpe sinto prefiro infelizmente recuso"
).split()
#: Words of dress around a question given back.
DRESS = "the question is was asks asked you we i answer answering to about that says reads repeat again here as follows q a la pregunta es die frage lautet question est pergunta é".split()
#: A word stands so often inside texts before its never ending one counts as proof that more must follow.
OFTEN = 20
#: So many everyday words tell the language of a refusal or a copied question, whose set phrases hold few, and some of several languages.
FORMULA_HITS = 3


_NOTHING, _DRESS, _OPEN = frozenset(NOTHING), frozenset(DRESS), frozenset(OPEN_WORDS)
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_LANGUAGES = {w: [k for k, own in _COMMON.items() if w in own] for own in _COMMON.values() for w in own}
_DECLINING = frozenset(DECLINING)
_SCRIPTS = [regex.compile(rf"\p{{Is{x}}}") for x in ("Latin", "Cyrillic", "Han")]
_WORD_ASCII, _PURE_ASCII = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z]+")
_NAMED = {k: regex.compile(rf"(?i)(?<!\pL)(?:{v})(?!\pL)") for k, v in NAMES.items()}
_REFUSAL = regex.compile("|".join(f"(?:{r})" for r in REFUSALS))
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_PURE = regex.compile(r"[\p{L}\p{M}]+")
_QUOTED = regex.compile("[\"“„«][^\"“”„«»]*[\"”“»]")
_CLOSERS = "\"”»’')]"
_STOPS = ".!?。！？"
_SENTENCE = regex.compile(rf"(?<=[.!?][{regex.escape(_CLOSERS)}]*) ")


def _flat(text: str | None) -> str:
    return " ".join((text or "").replace("\u200b", " ").replace("\ufeff", " ").split())


def _words(text: str) -> list[str]:
    return (_WORD_ASCII if text.isascii() else _WORD).findall(text)


def language(text: str, words: list[str]) -> str | None:
    """The language of a text, or None if it can't be told: by script, else by the common words, one language leading."""
    latin, cyrillic, han = (len(x.findall(text)) for x in _SCRIPTS) if not text.isascii() else (1, 0, 0)
    if cyrillic > max(latin, 2):
        return "ru"
    if han * 2 > latin and han > 1:
        return "zh"
    hits = dict.fromkeys(_COMMON, 0)
    for w in words:
        for k in _LANGUAGES.get(w, ()):
            hits[k] += 1
    first, second = sorted(((n, k) for k, n in hits.items()), reverse=True)[:2]
    return first[1] if first[0] > second[0] else None


def _wrapped(words: list[str]) -> str:
    return "".join(f" {w} " for w in words)


def copies(text: str, words: list[str], q_words: list[str]) -> bool:
    """Whether the text only gives the question, or most of it, back, in whatever dress."""
    if len(q_words) < 3 or len(words) < 3:
        return False
    given, whole = _wrapped(words), _wrapped(q_words)
    if whole in given:
        return all(w in _DRESS for w in given.replace(whole, " ").split())
    return len(words) > 4 and given in whole and (text.rstrip(_CLOSERS).endswith("?") or len(words) * 2 > len(q_words))


def refuses(text: str) -> bool:
    """Whether the text declines to answer; what it only quotes doesn't count."""
    rest = _QUOTED.sub(" ", text)
    said = (rest if len(_words(rest)) > 2 else text).lower()
    return bool(_REFUSAL.search(regex.sub("[’`´]", "'", said).strip()))


def ends_openly(text: str) -> tuple[bool, str]:
    """(whether more must follow for sure, else the last word if there is no stop after it)."""
    bare = text.rstrip(" .…")
    if text.rstrip(_CLOSERS)[-1:] in _STOPS and not text.endswith(".."):
        return False, ""
    if sum(bare.count(c) for c in "([{") > sum(bare.count(c) for c in ")]}") or bare[-1:] in ",;:-–—":
        return True, ""
    tail = regex.search(r"[\p{L}\p{M}]+$", bare)
    return (True, "") if tail and tail[0].lower() in _OPEN else (False, tail[0] if tail else "")


def defects(question: str | None, options: list[str | None] | None, answer: str | None, explanation: str | None) -> Iterator[tuple[str, str | None]]:
    """Each (defect, None) of one record, and ("truncated", last word) where the vocabulary has to tell."""
    asked = _flat(question)
    q_words = _words(asked.lower())
    q_lang = language(asked, q_words)
    offered = {_flat(o).lower() for o in options or ()}
    complete = {o.rstrip(".…") for o in offered}
    for part, raw in ("answer", answer), ("explanation", explanation):
        text = _flat(raw)
        words = _words(text.lower())
        is_option = part == "answer" and text.lower() in offered
        if not words or " ".join(words) in _NOTHING and not is_option:
            yield "empty_answer", None
            continue
        copied = copies(text, words, q_words)
        declined = not copied and (not text.isascii() or not _DECLINING.isdisjoint(words)) and refuses(text)
        if copied:
            yield "copies_question", None
        elif declined:
            yield "refusal", None
        lang = language(text, words)
        if q_lang and lang and lang != q_lang and not _NAMED[lang].search(asked):
            own, hits = (sum(w in _COMMON.get(x, ()) for w in words) for x in (q_lang, lang))
            other_script = lang in ("ru", "zh") or q_lang in ("ru", "zh")
            if other_script or hits > own + (own > 0) and (hits >= FORMULA_HITS or not (copied or declined)):
                yield "other_language", None
        given_whole = copied and words[-len(q_words) :] == q_words
        if not given_whole and not (part == "answer" and text.lower().rstrip(".…") in complete):
            sure, tail = ends_openly(text)
            if sure or tail:
                yield "truncated", None if sure else tail


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The defects of each record, and the words inside texts and at an end, counted within the batch, in one table."""
    for batch in batches:
        found, inside, ending = [], Counter(), Counter()
        for key, question, options, answer, explanation in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found += [(key, *row) for row in dict.fromkeys(defects(question, options, answer, explanation))]
            known = [f"{_flat(o).rstrip('.…')}." for o in options or () if o]
            for text in (_flat(question), _flat(answer), _flat(explanation), *known):
                for sentence in _SENTENCE.split(text) if ". " in text or "! " in text or "? " in text or not text.isascii() or any(c in text for c in _CLOSERS) else (text,):
                    words = (_PURE_ASCII if sentence.isascii() else _PURE).findall(sentence.lower())
                    if words:
                        last = words.pop()
                        if sentence.rstrip(_CLOSERS)[-1:] in _STOPS and not sentence.endswith(".."):
                            ending[last] += 1
                        inside.update(words)
        words = [*{**inside, **ending}]
        ids, kinds, tails = zip(*found, strict=True) if found else ((), (), ())
        blank, unfound = [None] * len(found), [None] * len(words)
        columns = (
            (pa.int64(), [*ids, *unfound]),
            (pa.string(), [*kinds, *unfound]),
            (pa.string(), [*tails, *unfound]),
            (pa.string(), [*blank, *words]),
            (pa.int64(), [*blank, *(inside[w] for w in words)]),
            (pa.int64(), [*blank, *(ending[w] for w in words)])
        )
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for kind, values in columns], ["question_id", "defect", "tail", "word", "inside", "ending"])


COLUMNS = ["question_id", "question", "options", "correct_answer", "explanation"]


def read_records(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, defect, tail) of every record, and (word, inside, ending) over the whole bank, from one pass.

    Counted is how often a word stands inside texts, and at the end of a sentence or of an option.  The last word of a
    text without a stop counts in neither, as it may be a piece.
    """
    kinds = "question_id long, defect string, tail string, word string, inside long, ending long"
    both = cut_lineage(spread(questions.select(COLUMNS)).mapInArrow(_read, kinds))
    words = both.where("word is not null").groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("ending").alias("ending"))
    return both.where("defect is not null").select("question_id", "defect", "tail"), words


def pair_defects(questions: DataFrame) -> DataFrame:
    """(question_id, defect), distinct: every defect of every record.

    Rules for one text: emptiness, which rules out all others; copied question, else refusal; besides, another language
    and truncation.  A copied question that ends as the question does isn't truncated.
    Null and blank texts are empty answers; a null question or null options switch off the rules that need them;
    repeated rows give one row; further columns are ignored.  A text is truncated if a bracket stays open, if it
    ends after a comma or a word of OPEN_WORDS, or, without a stop, after a word that never ends a sentence though
    it is frequent, or after an unknown word with which a longer one begins.
    """
    judged, words = read_records(questions)
    sure = judged.where("tail is null").select("question_id", "defect")
    open_ends = judged.where("tail is not null").withColumn("word", F.lower("tail"))
    words = cut_lineage(words)
    begun = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))
    pieces = words.where("length(word) > 1").select(F.explode(begun).alias("word")).distinct().withColumn("piece", F.lit(True))
    met = open_ends.join(words, "word", "left").join(pieces, "word", "left").fillna(0, ["inside", "ending"])
    cut_word = (F.col("inside") + F.col("ending") == 0) & F.col("piece").isNotNull()
    goes_on = (F.col("ending") == 0) & (F.col("inside") >= OFTEN) & (F.col("tail") == F.col("word"))
    return sure.unionByName(met.where(cut_word | goes_on).select("question_id", "defect")).distinct()
