"""Broken prompt and response pairs: a multi-label linear classifier.

The classifier never sees a labelled pair.  A bounded sample of pairs that look sound is
damaged on purpose: responses are cut off, replaced by the instruction, swapped for a response in
another language, or for a refusal; the sound originals, without their full
stop, with a foreign quotation, with the instruction restated, swapped within their language, or
replaced by a short answer (a word, a number, a name, a list), are the other side.
Features are hashed n-grams and features of the pair, a family for each label; each label
has a logistic model.  Its cut is set on scores from cross-validation, in which sound rows weigh as
much as they would where a defect has a share of ``BASE``, and lies above the score of a pair
without evidence.

Languages are told apart by character n-grams of lower-case words.  Their profiles start
from a list of frequent words and are learned from the sample's own texts.
"""

from __future__ import annotations

import random
import re
import unicodedata
from array import array
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.words import INVISIBLE
from loam.session import map_arrow, ship

#: Largest sample of pairs that the models are fitted on, buckets of hashed features, labels of the models.
SAMPLE, BUCKETS, LABELS = 2000, 1 << 17, ("truncated", "refusal", "copy", "language")
#: Share of pairs with a given defect that the cuts are set for, folds of the cross-validation, least distance of a cut from a pair without evidence.
BASE, FOLDS, MARGIN = 0.03, 4, 0.25
#: Score (log-odds, by models of other folds) from which a pair of the sample is not taken for sound.
DOUBT = 2.0
#: Buckets of hashed character n-grams, evidence (in nats) from which a language is named.
GRAMS, NAMED = 1 << 14, 1.5

#: Frequent words that the profiles of the languages start from.
MARKERS = {
    "en": "the of and to in is that any each another one when after before which what how why its it this with for while may must can if under has have from a an",
    "de": "der die das und ist nicht ein eine einen dem den des zu für mit auf wenn wie was warum wann wird zuerst nach sobald obwohl weil doch erst ab im bei über unter von",
    "fr": "le la les des du un une et est dans pour que qui avec sur lorsque quand comment pourquoi puis car mais dès bien après au aux ce cette il ne pas d l en quel quelle",
    "es": "el la los las del un una y es en para que con por cuando cómo qué porque pero aunque según después tras al se no su más lo cuándo primero",
}
LANGUAGES = tuple(MARKERS)
#: How an instruction asks for a language.
ASKED = {
    "en": r"\b(?:in(?:to)? english|auf englisch|ins englische|en anglais|en inglés|al inglés)\b",
    "de": r"\b(?:in(?:to)? german|a german|auf deutsch|ins deutsche|en allemand|en alemán|al alemán)\b",
    "fr": r"\b(?:in(?:to)? french|a french|auf französisch|ins französische|en français|en francés|al francés)\b",
    "es": r"\b(?:in(?:to)? spanish|a spanish|auf spanisch|ins spanische|en espagnol|en español|al español)\b",
}
_ASKED = {k: re.compile(v) for k, v in ASKED.items()}
#: What stands for nothing.
NOTHING = frozenset("null none nil na nan n/a empty undefined tbd todo".split())

#: Words with which a response speaks of itself.
FIRST_PERSON = frozenset("i i'm i'd ich je désolé siento puedo debo sorry".split())

_TOKEN = re.compile(r"```|\w+(?:[-'’]\w+)*|[^\w\s]")
_NAME = re.compile(r"0x[0-9a-f]+|[A-Z]{2,}\w*(?:-\d+)?|[A-Z][a-z]+-\d+|\d+(?:[.,:]\d+)*|[a-z]+-\d+")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_ITEM = re.compile(r"(?:^|\n)\s*(?:\d+[.)]|[-*•])\s*$")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def clean(text: str | None) -> str:
    """NFKC without invisible characters and outer blanks; null becomes empty."""
    return unicodedata.normalize("NFKC", text or "").translate(INVISIBLE).replace("’", "'").strip()


def says_nothing(response: str | None) -> bool:
    """Whether a response has no letter or digit outside of markup, or only a word for nothing."""
    x = _TAG.sub(" ", clean(response))
    return not _WORD.search(x) or x.strip(" .\"'()[]{}<>").lower() in NOTHING


def _grams(word: str) -> list[int]:
    """The places of a word's n-grams and, last, of the whole word."""
    x = f"^{word}$"
    return [crc32(x[i : i + n].encode()) & (GRAMS - 1) for n in (2, 3, 4) for i in range(len(x) - n + 1)] + [crc32(f"={word}".encode()) & (GRAMS - 1)]


def plain_words(text: str) -> list[str]:
    """Words in lower case, outside of blocks of code: what tells languages apart (names do not)."""
    return [w for w in _LETTERS.findall(_CODE.sub(" ", text)) if w.islower()]


class Profiles:
    """Character n-grams of the four languages: log-probabilities by language and bucket."""

    def __init__(self, texts: list[str], rounds: int = 2):
        """From the MARKERS first, then from the texts that these profiles can name."""
        seeds = [Counter({w: 3 for w in v.split()}) for v in MARKERS.values()]
        self.learn(seeds)
        split = [plain_words(x) for x in texts]
        for _ in range(rounds):
            words = [Counter(c) for c in seeds]
            for own in split:
                at = self.name(own)
                if at:
                    words[LANGUAGES.index(at)].update(own)
            self.learn(words)

    def learn(self, words: list[Counter]) -> None:
        """Profiles of counted words; a word counts by the root of its frequency, so that no frequent word is the language."""
        self.seen: dict[str, np.ndarray] = {}
        n = np.full((len(LANGUAGES), GRAMS), 0.2)
        for row, counter in zip(n, words):
            for w, times in counter.items():
                np.add.at(row, _grams(w), times**0.5)
        self.logs = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)

    def evidence(self, word: str) -> np.ndarray:
        """What a word says for each language; an n-gram shares its letters with two others."""
        if (found := self.seen.get(word)) is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            v = self.logs[:, _grams(word)]
            v = v[:, :-1].sum(1) / 3 + v[:, -1]
            found = self.seen[word] = np.clip(v - v.mean(), -3, 3)
        return found

    def total(self, words: list[str]) -> np.ndarray:
        return np.sum([self.evidence(w) for w in words], 0) if words else np.zeros(len(LANGUAGES))

    def name(self, words: list[str]) -> str:
        """The language of lower-case words, or '' without enough evidence."""
        v = self.total(words)
        a, b = np.argsort(-v)[:2]
        return LANGUAGES[a] if v[a] - v[b] >= NAMED else ""

    def language(self, text: str) -> str:
        """The language of a text, or ''."""
        return self.name(plain_words(text))

    def expected(self, instruction: str) -> set[str]:
        """The instruction's own language and those that it asks for."""
        low = instruction.lower()
        return {k for k, r in _ASKED.items() if r.search(low)} | ({k} if (k := self.language(instruction)) else set())


def _shape(token: str, first: bool, known: frozenset) -> str:
    if _NAME.fullmatch(token):
        return "#" if token[0].isdigit() and token[:2] != "0x" else "N"
    low = token.lower()
    if low in known or not token[0].isalpha():
        return low
    return "N" if token[:1].isupper() and not first and len(token) > 3 else ("Wn" if token[:1].isupper() else "Un")


def _tokens(text: str, known: frozenset) -> list[str]:
    out, first = [], True
    for t in _TOKEN.findall(text):
        out.append(_shape(t, first, known))
        first = t in ".!?```:-"
    return out


def features(instruction: str | None, response: str | None, known: frozenset, profiles: Profiles) -> dict[str, dict[str, float]]:
    """The named features of a pair, by label."""
    ask, say = clean(instruction), clean(response)
    toks = _tokens(say, known)
    # truncation: how the response ends
    end = {"bias": 1.0}
    body = say.rstrip("\"'*_”»").rstrip()
    last = body[-1:]
    fences = say.count("```")
    item = bool(_ITEM.search(say))
    stop = last in ".!?…" and not item  # the mark of an item without words ends no sentence
    tail = [t for t in toks if t not in "\"'*_”»"] or [""]
    end["stop" if stop else ("fence" if last == "`" else ("mark" + last if last and not last.isalnum() else "word"))] = 2.0
    if item:
        end["empty item"] = 4.0
    if fences % 2:
        end["open fence"] = 3.0
    for a, b in ("()", "[]", "{}"):
        if say.count(a) > say.count(b):
            end["open bracket"] = 3.0
    lines = [x for x in say.split("\n") if x.strip()]
    listed = sum(bool(re.match(r"\s*(?:[-*•]|\d+[.)])(?:\s|$)", x)) for x in lines)
    if lines and listed == len(lines):
        end["list"] = 1.0
    if not stop and last != "`":
        for n in (1, 2, 3, 4) if "list" not in end else ():  # an item may end with any word
            end["end" + " ".join(tail[-n:])] = 1.0
        cut = max((i for i, t in enumerate(tail) if t in ".!?:"), default=-1)
        sentence = tail[cut + 1 :]
        end["sentence of " + str(min(len(sentence), 12))] = 0.5
        end["earlier sentences"] = min(cut + 1, 1) * 0.5
        if tail[-1] in ("Un", "Wn"):
            end["unknown end"] = 2.0
        if len(sentence) == 1:
            end["only word" if len(tail) == 1 else "one word"] = 2.0
        if not FIRST_PERSON.isdisjoint(t.lower() for t in toks):
            end["first person"] = 1.0
        asked = _WORD.findall(ask.lower())
        if asked and asked[-1:] == _WORD.findall(body[-60:].lower())[-1:]:
            end["ends as asked"] = 2.0
    # refusal: n-grams of the whole response
    ref = {"bias": 1.0}
    scale = 1.0 / max(4.0, len(toks)) ** 0.5
    for n in (1, 2, 3):
        for i in range(len(toks) - n + 1):
            ref["r" + " ".join(toks[i : i + n])] = scale * n
    ref["short"] = 1.0 if len(toks) < 30 else 0.0
    # copy: what of the response is the instruction
    cop = {"bias": 1.0}
    a, b = ([w for w in _WORD.findall(x.lower()) if w not in ("a", "an", "the")] for x in (ask, say))
    if a and b:
        ca = Counter(a)
        inside = sum(w in ca for w in b) / len(b)
        pa_, pb = set(zip(a, a[1:])), list(zip(b, b[1:]))
        pairs = sum(p in pa_ for p in pb) / len(pb) if pb else 0.0
        back = sum(w in set(b) for w in a) / len(a)
        extra = sum(w not in ca for w in b)
        cop |= {"inside": inside * 2, "pairs": pairs * 2, "back": back * 2, "inside pairs back": 4 * inside * pairs * back}
        cop["extra" + str(min(extra, 8))] = 1.0
        cop["extra"] = min(extra, 24) / 8
        cop["ends in other words"] = 3.0 * (b[-1] not in ca)
        cop["len" + str(min(8, round(4 * len(b) / len(a))))] = 0.5
    else:
        cop["no words"] = 1.0
    # language: what the response's words say against the languages that are expected; nothing without words or expectation
    lan: dict[str, float] = {}
    want = profiles.expected(ask) if a else set()
    own = plain_words(say)
    if want and len(own) > 1:  # one word is too little to tell
        v = profiles.total(own)
        inside = [k in want for k in LANGUAGES]
        gap = max((x for x, k in zip(v, inside) if not k), default=-50.0) - max(x for x, k in zip(v, inside) if k)
        lan = {"bias": 1.0, "gap": 2 * float(np.clip(gap / len(own) ** 0.5, -4, 4)), "sign": 2 * float(np.clip(gap, -NAMED, NAMED))}
        scale = 0.5 / max(6.0, len(own)) ** 0.5
        key = "+".join(sorted(want))
        for w in own:
            if w in known:
                lan[f"{key}|{w}"] = lan.get(f"{key}|{w}", 0.0) + scale
    return dict(zip(LABELS, (end, ref, cop, lan)))


def _hashed(named: dict[str, float]) -> tuple[list[int], list[float]]:
    return [crc32(k.encode()) & (BUCKETS - 1) for k in named], list(named.values())


# -- damage ---------------------------------------------------------------------------------

#: Openings, cores and ends of refusals, by language.
REFUSALS = {
    "en": (
        ["", "", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "As a language model, ", "As an assistant, ", "Thank you for asking. ", "Short answer: ", "I apologize, but ", "To be honest, ", "I appreciate the question, but "],
        ["I cannot help with that", "I can't help with that", "I can't assist with this request", "I cannot assist with this request", "I am not able to answer this question", "I'm unable to answer that",
         "I have to decline", "I must decline to answer", "I must refuse to answer this", "I won't be able to provide that", "I will not answer this", "that is not something I can comment on", "that is not something I can discuss",
         "I don't have enough information to answer", "I do not have the information needed to answer", "I would rather not answer this", "I am not allowed to answer that", "I cannot provide that information", "I can't say anything about {n}", "I must refuse to say anything about {n}"],
        ["", ".", ".", ".", ". Please consult a qualified engineer.", ". Is there anything else you would like to know?", " because it may be sensitive.", ", and I would ask you to contact your vendor instead.", ". Please ask something else.", " at this time."],
    ),
    "de": (
        ["", "", "Leider ", "Es tut mir leid, ", "Als Sprachmodell "],
        ["dabei kann ich nicht helfen", "kann ich diese Frage nicht beantworten", "ich kann diese Frage nicht beantworten", "ich muss es ablehnen, über {n} zu sprechen", "ich muss die Antwort zu {n} verweigern", "dazu darf ich nichts sagen", "dazu kann ich keine Auskunft geben", "bin ich nicht in der Lage, dabei zu helfen", "ich muss ablehnen", "zu {n} muss ich die Auskunft ablehnen"],
        ["", ".", ".", ". Bitte wenden Sie sich an Ihren Hersteller.", ". Kann ich sonst noch helfen?"],
    ),
    "fr": (
        ["", "", "Je suis désolé, ", "Désolé, ", "Malheureusement, ", "En tant que modèle de langue, "],
        ["je ne peux pas répondre à cette question", "je ne suis pas en mesure de vous aider sur ce point", "je dois refuser de répondre au sujet de {n}", "je ne peux pas vous aider", "je dois décliner", "je ne suis pas autorisé à en parler", "je n'ai pas assez d'informations pour répondre", "il m'est impossible de répondre"],
        ["", ".", ".", ". Veuillez contacter votre fournisseur.", ". Puis-je vous aider autrement ?"],
    ),
    "es": (
        ["", "", "Lo siento, ", "Lamentablemente, ", "Como modelo de lenguaje, "],
        ["no puedo responder a esta pregunta", "no me es posible ayudarle con eso", "debo negarme a responder sobre {n}", "no puedo ayudarle", "tengo que negarme", "no estoy autorizado a hablar de ello", "no tengo información suficiente para responder", "me resulta imposible contestar"],
        ["", ".", ".", ". Consulte a su proveedor.", ". ¿Puedo ayudarle en algo más?"],
    ),
}


def refuse(lang: str, name: str, rng: random.Random) -> str:
    """A made refusal."""
    parts = [rng.choice(x) for x in REFUSALS.get(lang, REFUSALS["en"])]
    text = "".join(parts).replace("{n}", name)
    return text[:1].upper() + text[1:]


def cut_off(text: str, name: str, rng: random.Random) -> str:
    """The text stopped before its end: within a word, a sentence, a list item, a bracket or a block of code."""
    if "```" in text:
        inner = text.rstrip("`\n ")
        at = rng.randint(max(4, len(inner) // 3), max(5, len(inner)))
        return inner[:at]
    if text.lstrip().startswith("- "):
        items = text.rstrip().split("\n")
        at = rng.randrange(1, len(items)) if len(items) > 1 else 0
        word = items[at].split()[-1] if len(items[at].split()) > 1 else ""
        return "\n".join(items[:at] + (["-"] if rng.random() < 0.4 or len(word) < 5 else [items[at][: -rng.randint(2, len(word) - 2)]]))
    if rng.random() < 0.08:
        head = rng.choice(["The steps are:", "Steps:", "Die Schritte:", "Les étapes :", "Los pasos:", "Checklist:"])
        return f"{text}\n{head}\n1. {rng.choice(['Check', 'Prüfen', 'Vérifier', 'Comprobar'])} {name}.\n{rng.choice(['2.', '2.', '2)', '-'])}"
    sentences = re.split(r"(?<=[.!?])\s+", text)
    keep, victim = sentences[: rng.randint(0, len(sentences) - 1)], sentences[rng.randrange(len(sentences))]
    words = re.findall(r"\S+", victim)
    if len(words) < 4:
        return text
    n = rng.randint(2, len(words) - 2)
    kind = rng.random()
    part = " ".join(words[:n])
    if kind < 0.35:
        long = [w for w in words[n:-1] if len(w) > 4 and w.isalpha()]
        if long:
            w = rng.choice(long)
            part += " " + w[: rng.randint(2, len(w) - 2)] + ("-" if rng.random() < 0.2 else "")
    elif kind < 0.45:
        part = part.rstrip(",.;") + ","
    elif kind < 0.55:
        part += f" (see the {name[: rng.randint(3, 8)]}"
    elif kind < 0.62:
        part = text + f"\n```\n description to-{name}\nset " + "unit"[: rng.randint(1, 4)]
        return part
    elif kind < 0.8:
        part += " " + rng.choice("with from for and of the by in to that under which mit und für der von pour et de avec des con y para del".split())
    return " ".join([*keep, part])


def copied(text: str, rng: random.Random) -> str:
    """The instruction given back, perhaps slightly changed."""
    words = text.split()
    ways = [
        lambda: text, lambda: text.lower(), lambda: text.upper(), lambda: f'"{text}"', lambda: "> " + text, lambda: text.rstrip("?. "),
        lambda: f"{text} {text}", lambda: text.rstrip("?.") + rng.choice(".!?"), lambda: " ".join(words[1:]), lambda: text + "\n" + text,
        lambda: " ".join("a" if w == "the" else w for w in words), lambda: " ".join(w for i, w in enumerate(words) if i != len(words) // 2), lambda: "**" + text + "**",
        lambda: " ".join([*words[:-2], words[-1]]), lambda: "Q: " + text, lambda: "You asked: " + text, lambda: "Question: " + text, lambda: "Instruction: " + text + "\n", lambda: "“" + text + "”",
    ]
    return rng.choice(ways)()


def is_restated(ask: str, say: str) -> bool:
    """Whether most words of a response stand in the instruction."""
    a, b = set(_WORD.findall(ask.lower())), _WORD.findall(say.lower())
    return bool(a) and len(b) >= 3 and sum(w in a for w in b) > 0.7 * len(b)


def looks_sound(ask: str, say: str, profiles: Profiles) -> bool:
    """Rules for the sample: a pair without a sign of any defect."""
    if says_nothing(say) or say.count("```") % 2 or say.count("(") > say.count(")") or _ITEM.search(say):
        return False
    if not re.search(r"[.!?][\"'”»]?$|```$", say) and not (say.startswith("- ") or len(say) < 40):
        return False
    if is_restated(ask, say) or not FIRST_PERSON.isdisjoint(_WORD.findall(say.lower())):
        return False
    want, got = profiles.expected(ask), profiles.language(say)
    return not (want and got and got not in want)


#: Short answers, by language.
SHORT = {"en": "Yes.|No.|Yes|No|Never.|Always.|No, only after {#}.|Yes, within {#}.|By default, no.|None.", "de": "Ja.|Nein.|Nie.|Ja, nach {#}.", "fr": "Oui.|Non.|Jamais.|Oui, après {#}.", "es": "Sí.|No.|Nunca.|Sí, tras {#}."}


def short_answer(lang: str, ask: str, say: str, name: str, rng: random.Random) -> str:
    """A sound answer of few words: a word, a number with or without its unit, a name, or a list."""
    amounts = re.findall(r"\b\d+ [^\W\d_]{3,}", say) or [f"{rng.randint(1, 60000)} {rng.choice(['bytes', 'ms', 'MB'])}"]
    amount = rng.choice(amounts)
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(SHORT.get(lang, SHORT["en"]).split("|")).replace("{#}", amount)
    if kind < 0.45:
        return amount + rng.choice(["", "."])
    if kind < 0.55:
        return rng.choice([f"0x{rng.randrange(256):02x}", f"0x{rng.randrange(65536):04x}", f"{rng.choice(['UDP', 'TCP'])} port {rng.randint(1, 65535)}", str(rng.randint(1, 9999))])
    if kind < 0.8:
        return name + rng.choice(["", "", "."])
    plain = [w for w in _LETTERS.findall(f"{ask} {say}") if w.islower() and len(w) > 3] or ["value"]
    mark = rng.choice(["- ", "- ", "* ", "• "])
    return "\n".join(mark + " ".join(rng.choice(plain) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 4)))


def training_rows(sample: list[tuple[str, str]], profiles: Profiles, rng: random.Random) -> list[tuple[int, str, str, set[str]]]:
    """(group, instruction, response, labels) of sound and of damaged pairs.

    The first row of a group is a sound pair as it stands.  'language?' or 'copy?' puts a row on neither
    side for that label: damage left no evidence of the language, or little but the instruction.
    """
    pairs = [(clean(i), clean(r)) for i, r in sample]
    sound = [(i, r) for i, r in pairs if looks_sound(i, r, profiles)]
    by_lang: dict[str, list[str]] = {}
    names = sorted({w for i, _ in sound for w in re.findall(r"\b[A-Z][a-z]{3,}(?:-\d+)?\b|\b[A-Z]{3,}\b|\b0x[0-9a-f]+\b", i[1:])}) or ["Node"]
    for _, r in sound:
        if (k := profiles.language(r)) and len(r) > 40:
            by_lang.setdefault(k, []).append(r)
    rows = []
    for g, (i, r) in enumerate(sound):
        want = sorted(profiles.expected(i))
        own = profiles.language(i) or "en"
        name = rng.choice(names)
        long = len(r.split()) >= 8
        rows.append((g, i, r, set()))
        if long and "```" not in r:
            rows.append((g, i, r.rstrip(".!"), set()))
            if not is_restated(i, first := re.split(r"(?<=[.!?])\s+", r)[0].rstrip(".!")):
                rows.append((g, i, first, set()))
        for _ in range(2):
            c = cut_off(r, name, rng)
            if c != r and len(c) > 3:
                rows.append((g, i, c, {"truncated", "copy?"} if is_restated(i, c) else {"truncated"}))
        rows.append((g, i, refuse(own, rng.choice([name, *re.findall(r"\b[A-Z]\w+", i[1:])[:1]]), rng), {"refusal"}))
        rows.append((g, i, refuse(rng.choice(LANGUAGES), name, rng), {"refusal", "language?"}))  # so that rare languages have some
        rows.append((g, i, short_answer(own, i, r, name, rng), set()))
        if i:
            rows.append((g, i, copied(i, rng), {"copy"}))
            rows.append((g, i, f"{i} {r}", set()))
        if len(want) == 1 and len(by_lang.get(want[0], ())) > 1:  # an answer to another question is none of the defects
            rows.append((g, i, rng.choice(by_lang[want[0]]), set()))
        far = [k for k in by_lang if want and k not in want]
        if far:
            other = rng.choice(by_lang[rng.choice(far)])
            rows.append((g, i, other, {"language"}))
            if len(c := cut_off(other, name, rng)) > 12 and c != other:
                rows.append((g, i, c, {"truncated", "language" if profiles.language(c) not in ("", *want) else "language?"}))
            quoted = " ".join(other.split()[1:3]).strip(".,")
            if want == ["en"] and long:
                rows.append((g, i, f'{r} Some call it "{quoted}" there.', set()))
    return rows


class _Rows:
    """Hashed features of all rows for one label; places are numbered densely, so that steps are bincounts."""

    def __init__(self, places: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.used, self.at = np.unique(places, return_inverse=True)
        self.value = values.astype(np.float64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.start[rows + 1] - self.start[rows]
        where = np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.at[where], self.value[where], np.repeat(np.arange(len(rows)), n)

    def train(self, y: np.ndarray, rows: np.ndarray, seed: int, rounds: int) -> np.ndarray:
        """Weights of a logistic model by adaptive steps over batches."""
        w, seen = np.zeros(len(self.used)), np.full(len(self.used), 1e-8)
        order, shuffle = rows.copy(), np.random.default_rng(seed)
        for _ in range(rounds):
            shuffle.shuffle(order)
            for k in range(0, len(order), 256):
                own = order[k : k + 256]
                i, v, row = self.take(own)
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[i] * v, len(own)), -30, 30)))
                g = np.bincount(i, (p - y[own])[row] * v, len(w)) / len(own)
                g += 1e-6 * w * (g != 0)
                seen += g * g
                w -= 0.3 * g / np.sqrt(seen)
        return w

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, len(self.start) - 1)


def _hashed_batch(asks: list[str], says: list[str], known: frozenset, profiles: Profiles) -> list[pa.ListArray]:
    """For each label the places and the values of all pairs' features."""
    made = {label: ([0], array("i"), array("f")) for label in LABELS}
    for i, r in zip(asks, says):
        for label, named in features(i, r, known, profiles).items():
            at, v = _hashed(named)
            ends, places, values = made[label]
            places.extend(at)
            values.extend(v)
            ends.append(len(places))
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for ends, places, values in made.values() for x in (pa.array(np.frombuffer(places, np.int32), pa.int32()), pa.array(np.frombuffer(values, np.float32), pa.float32()))]


def _hashed_rows(rows: list[tuple], known: frozenset, profiles: Profiles, spark: SparkSession | None) -> dict[str, _Rows]:
    """The hashed features of the rows by label, made by the session's tasks if there is one; the rows follow from a sample of bounded size."""
    asks, says = [r[1] for r in rows], [r[2] for r in rows]
    names = [f"{label}_{k}" for label in LABELS for k in ("at", "v")]
    if spark is None:
        table = pa.table(_hashed_batch(asks, says, known, profiles), names)
    else:
        ship(spark)
        shared = spark.sparkContext.broadcast((known, profiles))

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), *_hashed_batch(b.column(1).to_pylist(), b.column(2).to_pylist(), *shared.value)], names=["n", *names])

        df = spark.createDataFrame(pa.table([pa.array(range(len(rows)), pa.int64()), pa.array(asks, pa.string()), pa.array(says, pa.string())], ["n", "i", "r"])).repartition(spark.sparkContext.defaultParallelism)
        table = map_arrow(df, run, "n bigint, " + ", ".join(f"{label}_at array<int>, {label}_v array<float>" for label in LABELS)).toArrow().sort_by("n")
    out = {}
    for label in LABELS:
        at, v = (table.column(f"{label}_{k}").combine_chunks() for k in ("at", "v"))
        out[label] = _Rows(at.flatten().to_numpy(), v.flatten().to_numpy(), np.diff(at.offsets.to_numpy().astype(np.int64)))
    return out


def fit(sample: list[tuple[str | None, str | None]], seed: int = 7, rounds: int = 8, spark: SparkSession | None = None) -> dict:
    """The models and cuts, from a sample of pairs; ``held_out`` has the F1 of each label over the folds. With a session its tasks make the features."""
    rng = random.Random(seed)
    sample = sorted({(i or "", r or "") for i, r in sample})
    # together: most pairs have one language, and more words name it better
    profiles = Profiles([f"{clean(i)}\n{clean(r)}" for i, r in sample if not any(a.search(i.lower()) for a in _ASKED.values())])
    rows = training_rows(sample, profiles, rng)
    words = Counter(w for _, i, r, y in rows if not y for w in set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", f"{i} {r}")))
    known = frozenset(w.lower() for w, n in words.items() if n >= 3 and w[1:].islower() or w in ("a", "I", "y"))
    known |= frozenset(w for text in REFUSALS.values() for part in text for x in part for w in _WORD.findall(x.lower()))
    made = _hashed_rows(rows, known, profiles, spark)
    group = np.array([g for g, *_ in rows], np.int64)
    fold = group % FOLDS
    first = np.concatenate([[True], group[1:] != group[:-1]])
    nothing = features("", "0", known, profiles)
    model: dict = {"known": known, "profiles": profiles, "weights": {}, "cut": {}, "held_out": {}}
    judged, doubtful = {}, np.zeros(len(sample), bool)
    for label in LABELS:
        y = np.array([np.nan if f"{label}?" in labels else label in labels for *_, labels in rows], float)
        x, score, clear = made.pop(label), np.zeros(len(rows)), ~np.isnan(y)
        for f in range(FOLDS):
            score[fold == f] = x.scores(x.train(y, np.flatnonzero((fold != f) & clear), seed, rounds))[fold == f]
        judged[label] = x, y, score, clear
        doubtful[group[first & (score > DOUBT)]] = True  # pairs that only looked sound
    for label, (x, y, score, clear) in judged.items():
        own = np.flatnonzero(clear & ~doubtful[group])
        w = np.zeros(BUCKETS)
        w[x.used] = x.train(y, own, seed, rounds)
        model["weights"][label] = w.astype(np.float32)
        cut, quality = _threshold(score[own], y[own])
        at, v = _hashed({k: n for k, n in nothing[label].items() if k in ("bias", "short", "no words")})
        model["cut"][label], model["held_out"][label] = max(cut, float(w[at] @ np.array(v)) + MARGIN), quality
    return model


def _threshold(score: np.ndarray, y: np.ndarray, base: float = BASE) -> tuple[float, float]:
    """The middle of the best cuts by F1 where the defect's share is ``base``, and that F1."""
    n, hits = len(y), y.sum()
    if not hits or hits == n:
        return 0.0, 0.0
    weight = (1 - base) / base * hits / (n - hits)  # of a row without the defect
    order = np.argsort(-score)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (hit + weight * (np.arange(1, n + 1) - hit) + hits)
    s = score[order]
    ends = np.append(s[1:] < s[:-1], True)  # rows of one score fall together
    best = np.flatnonzero(ends & (f1 >= f1[ends].max() - 1e-12))
    low = s[best[-1] + 1] if best[-1] + 1 < n else s[best[-1]] - 1
    return float((s[best[-1]] + low) / 2), float(f1[best[-1]])


def defects(instruction: str | None, response: str | None, model: dict) -> list[str]:
    """The defects of one pair: 'empty', or every label whose score is above its cut."""
    if says_nothing(response):
        return ["empty"]
    named = features(instruction, response, model["known"], model["profiles"])
    out = []
    for label in LABELS:
        i, v = _hashed(named[label])
        if i and float(model["weights"][label][i] @ np.array(v, np.float32)) > model["cut"][label]:
            out.append(label)
    return out


def sample_of(df: DataFrame, key: str, instruction: str, response: str, most: int = SAMPLE) -> list[tuple[str | None, str | None]]:
    """At most ``most`` pairs, those with the smallest hashes of their key; of a key's different pairs the smallest.

    Only keys whose hash lies in a range that holds about four times as many rows go through the aggregate.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    x = df.select(key, F.struct(instruction, response).alias("pair"), place.alias("place"))
    if total > 8 * most:
        x = x.where(F.col("place") < F.lit(int(4 * most / total * (1 << 20)) + 1))
    rows = x.groupBy(key, "place").agg(F.min("pair").alias("pair")).orderBy("place", key).limit(most).collect()
    return [(r.pair[0], r.pair[1]) for r in rows]


def broken_pairs(df: DataFrame, key: str, instruction: str, response: str, model: dict | None = None) -> DataFrame:
    """(key, defect): one row for each defect of a pair; rows delivered twice count once.

    Defects: empty (never with another), truncated, refusal, copy, language.  A null or
    empty instruction is no defect and rules out copy and language.  Whole texts are read.
    An empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    if model is None:
        model = fit(sample_of(df, key, instruction, response), spark=df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # four models of BUCKETS floats and the sample's frequent words

    def run(batches):
        m = shared.value
        for b in batches:
            found = [defects(i, r, m) for i, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            rows = [n for n, x in enumerate(found) for _ in x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([d for x in found for d in x], pa.string())], names=[key, "defect"])

    return map_arrow(df.select(key, instruction, response), run, f"`{key}` {kind}, defect string").distinct()
