"""Subject areas of documents by weighted terms.

The terms are words of a bounded set of labelled examples that occur with one subject
(almost) only, their regular inflections, and a short curated list.  One automaton
finds them all in one pass over a text; each sentence goes to the subject with the largest
weight, where rare terms weigh more (by document frequencies over the whole corpus).
A document's score for a subject is the share of its sentences, and the threshold is set
where the scores of the corpus leave their widest gap between "in passing" and "deals with".
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.words import readings
from loam.operators.grouping import first_k
from loam.session import map_arrow, written

#: Largest number of labelled examples (shared equally by the subjects), purity that a term needs, share below which a subject is in passing, and share that counts.
EXAMPLES, PURE, PASSING, DEALS = 5000, 0.8, 0.08, 0.15
#: Terms a lexicon may have (more are an error); a sentence's terms are stored as sentence * TERMS + term.
TERMS = 1 << 20

#: Curated terms, most of them words of a field that few examples hold.
CURATED = {
    "routing": "topology adjacency advertise advertises flood floods next-hop link-state sistema autónomo,système autonome,autonomes system,encaminamiento,routage,nachbarschaft,vecindad,voisinage,enrutador,routeur",
    "switching": "encapsulate encapsulates flush flushes tag tags vlan port-channel portgruppe conmutador commutateur vermittlungsebene uplink enlace ascendente,liaison montante,spanning tree,mac table,carte de ligne,tarjeta de línea",
    "security": "cipher encrypt encrypts handshake passphrase revoke revokes intrusion intrusion sensor,access list,zugriffsliste,cortafuegos,pare-feu,contraseña,mot de passe,kennwort,cifrado,chiffrement,intrusión,détection d intrusion,menace,amenaza",
    "telemetry": "syslog poller dashboard anomaly health score,compliance check,time series,flow record,log export,sensor path,tableau de bord,panel de control,serie temporal,série temporelle,messreihe,zählerabfrage,recolección,registros,inventario,inventaire",
    "wireless": "attenuate attenuates handover roaming subcarrier airtime guard interval,steer steers coverage cell,base station,access point,transmit power,funkzelle,funkspektrum,funksignal,estación base,station de base,spectre,itinérance,itinerancia,celda,cellule,basisstation",
    "storage": "namespace replicate replicates stripes archived deduplication lun replik datensicherung bandbibliothek blockgerät cache d écriture,caché de escritura,copia de seguridad,sauvegarde,bandothèque,biblioteca de cintas,matriz de discos,baie de stockage,speicherarray,périphérique bloc",
    "software": "class interface debugs deploys import imports instantiate instantiates refactor refactors compiler interpreter pull request,unit test,build script,stack trace,open source,fehlersuche,quelltext,quelltexts,testsuite,compilador,compilateur,depurador,débogueur,repositorio,dépôt,prueba unitaria,test unitaire,fonction,función",
    "science": "hypothesis microbial radiate radiates electron isotope measure enzyme umlaufbahn órbita orbite teleskop telescopio télescope molekül molécula molécule hypothese hipótesis hypothèse galaxie galaxia experimento expérience",
    "law": "copyright license overturns statute indemnity klägerin vertragsklausel urheberrecht derecho de autor,droit d auteur,demandante,plaignante,apelación,berufung,cláusula,jugement,sentencia,haftung,responsabilidad,responsabilité",
    "sport": "dribble dribbles relay midfielder goalkeeper torneo tournoi torhüterin portera gardienne gardienne de but,elfmeterschießen,tirs au but,tanda de penaltis,meisterschaft,campeonato,championnat,relevo,relais,staffel,árbitro,arbitre",
}

#: Words that two subjects share.
SHARED = {
    "spectrum": "science wireless", "espectro": "science wireless", "spectre": "science wireless", "court": "law sport", "snapshot": "storage telemetry", "degraded": "storage telemetry",
    "sensor": "security telemetry", "access": "security wireless", "line": "switching wireless", "library": "software storage", "collector": "software telemetry", "score": "sport telemetry",
}

_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:-[^\W\d_]+)*(?!\w)")
_BLANK_LINE = re.compile(r"\n[ \t>|]*(?=\n)|\f")
_WRAP = re.compile(r"\s*\n[ \t>|]*")
_END = re.compile(r"([.!?。])[\"'”»)\]}]*(?:\s+|$)")
_CODE = re.compile(r"```(?:.*?```|.*?(?=\n[ \t]*\n|\Z))", re.S)  # a block that is not closed ends at a blank line
_DASH = dict.fromkeys(range(0x2010, 0x2016), "-")
_MOJIBAKE = re.compile("[Â-ôŠš][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")
_TAG = re.compile(r"</?[a-z][^<>]{0,200}>")


def _redecoded(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m[0].encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m[0]


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: lower case, broken words and lines joined, wrong decodings put right.

    A sentence has four words or more and ends with a mark; code, commands and titles are none.
    """
    if not text:
        return []
    if not text.isascii():
        text = _MOJIBAKE.sub(_redecoded, text)
    found = readings(text)
    x = found[0] if found else ""
    if "<" in x:
        x = _TAG.sub(" ", x)
    if "```" in x:
        x = _CODE.sub("\n\n", x)
    if not x.isascii():
        x = x.translate(_DASH)
    out = []
    for block in _BLANK_LINE.split(x):
        parts = _END.split(_WRAP.sub(" ", block.strip()))
        for s in parts[:-1:2]:
            w = _WORD.findall(s)
            if len(w) >= 4:
                out.append(" ".join(w))
    return out


def lexicon(examples: list[tuple[str, str]], curated: dict[str, str] | None = None) -> list[tuple[str, dict[str, float]]]:
    """(term, subject -> purity) from labelled texts.

    Terms are words of one subject, their regular inflections, curated terms, and curated
    words of two subjects (half a vote each, so that the rest of the sentence or document decides).
    Words of one example only must stand there in lower case, which names do not.
    """
    seen: dict[str, Counter] = defaultdict(Counter)
    apart: dict[str, set] = defaultdict(set)
    low: set[str] = set()
    for k, (subject, text) in enumerate(examples):
        low.update(w for w in _WORD.findall(text) if w.islower())
        for s in sentences(text):
            for w in set(s.split()):
                seen[w][subject] += 1
                apart[w].add(k)
    subjects = {s for s, _ in examples}
    terms: dict[str, dict[str, float]] = {}
    for w, by in seen.items():
        if len(w) < 3 or by.total() < 2 or not (w in low or len(apart[w]) > 1):
            continue
        first, n = by.most_common(1)[0]
        if n / by.total() >= PURE and w not in SHARED:
            terms[w] = {first: (n + 0.5) / (by.total() + 1)}
    for w, by in list(terms.items()):
        for form in (w + "s", w + "es", w[:-1] if w.endswith("s") else "", w[:-2] if w.endswith("es") else "", w[:-1] + "ies" if w.endswith("y") else "", w[:-3] + "y" if w.endswith("ies") else ""):
            if len(form) > 3 and form not in terms and form not in seen and form not in SHARED:
                terms[form] = {s: p * 0.8 for s, p in by.items()}
    for w, two in SHARED.items():
        if subjects.issuperset(two.split()):
            terms[w] = dict.fromkeys(two.split(), 0.5)
    for subject, text in (CURATED if curated is None else curated).items():
        if subject in subjects:
            for part in text.split(","):
                for t in _curated_terms(part.split()):
                    if t not in seen:
                        terms.setdefault(t, {subject: 0.9})
    if len(terms) >= TERMS:
        raise ValueError(f"{len(terms)} terms, more than a lexicon may have: take fewer examples")
    return sorted(terms.items())


#: Curated terms of several words.
PHRASES = frozenset(
    "sistema autónomo|système autonome|autonomes system|enlace ascendente|liaison montante|spanning tree|mac table|carte de ligne|tarjeta de línea|intrusion sensor|access list|mot de passe|détection d intrusion|health score|compliance check|time series|flow record|log export|sensor path|tableau de bord|panel de control|serie temporal|série temporelle|guard interval|coverage cell|base station|access point|transmit power|estación base|station de base|cache d écriture|caché de escritura|copia de seguridad|biblioteca de cintas|matriz de discos|baie de stockage|périphérique bloc|pull request|unit test|build script|stack trace|open source|prueba unitaria|test unitaire|derecho de autor|droit d auteur|gardienne de but|tirs au but|tanda de penaltis".split("|")
)


def _curated_terms(words: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(words):
        for n in (3, 2):
            if " ".join(words[i : i + n]) in PHRASES:
                out.append(" ".join(words[i : i + n]))
                i += n
                break
        else:
            out.append(words[i])
            i += 1
    return out


def _automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        a.add_word(f" {t} ", k)
    a.make_automaton()
    return a


def term_matches(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, n_sentences, hits): each hit is sentence * TERMS + term, once a sentence and term."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        auto = _automaton(terms) if terms else None
        for batch in batches:
            n, hits, sizes = [], [], [0]
            for x in batch.column(1).to_pylist():
                found = sentences(x)
                n.append(len(found))
                if found and auto is not None:
                    joined = " " + " \n ".join(found) + " "
                    ends, at = [], 0
                    for s in found:
                        at += len(s) + 3
                        ends.append(at)
                    own = {bisect_left(ends, e + 1) * TERMS + k for e, k in auto.iter(joined)}
                    hits.extend(sorted(own))
                sizes.append(len(hits))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(hits, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists], names=[key, "n_sentences", "hits"])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, n_sentences bigint, hits array<bigint>")


def subject_shares(matched: DataFrame, key: str, subjects: list[str], weight: np.ndarray) -> DataFrame:
    """(key, subject, n_sentences, share): the share of sentences that go to each subject that has any; ``weight`` is by term and subject.

    A sentence goes to the subject of the largest summed weight, if that reaches the
    weight of a frequent shared term; where two are equal it goes to the one with more sentences.
    """
    kind = matched.schema[key].dataType.simpleString()
    least = 0.15

    def run(batches):
        for b in batches:
            keys, n, lists = b.column(0), b.column(1).to_numpy(), b.column(2)
            hits, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows = np.repeat(np.arange(len(n)), np.diff(off))
            hits = hits[off[0] : off[-1]]
            place, term = np.divmod(hits, TERMS)
            # one line a sentence, one column a subject
            span = int(place.max()) + 1 if len(place) else 1
            code, line = np.unique(rows * span + place, return_inverse=True)
            table = np.zeros((len(code), len(subjects)))
            np.add.at(table, line, weight[term])
            best = table.max(1) if len(code) else np.zeros(0)
            winners = (table >= best[:, None] - 1e-9) & (best[:, None] >= least)
            owner = code // span
            clear = winners.sum(1) == 1
            count = np.zeros((len(n), len(subjects)))
            np.add.at(count, owner[clear], winners[clear])
            for i in np.flatnonzero(winners.sum(1) > 1):
                own = np.flatnonzero(winners[i])
                count[owner[i], own[np.argmax(count[owner[i], own])]] += 1
            r, s = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(r)), pa.array(np.array(subjects, object)[s], pa.string()), pa.array(n[r]), pa.array(count[r, s] / np.maximum(n[r], 1))],
                names=[key, "subject", "n_sentences", "share"],
            )

    return map_arrow(matched, run, f"`{key}` {kind}, subject string, n_sentences bigint, share double")


def calibrated(shares: DataFrame, steps: int = 200, least_sentences: int = 13) -> float:
    """The middle of the widest gap in the shares of long texts between PASSING and DEALS."""
    bins = (
        shares.where((F.col("n_sentences") >= least_sentences) & (F.col("share") > PASSING) & (F.col("share") < DEALS))
        .groupBy(F.floor(F.col("share") * steps).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )  # at most steps rows
    lo, hi = int(PASSING * steps), int(DEALS * steps)
    full = {r.b: r.n for r in bins}
    most = 0.02 * max(1, sum(full.values()))
    best, start = (0, lo, hi), None
    for k in range(lo, hi + 1):
        empty = k < hi and full.get(k, 0) <= most
        if empty and start is None:
            start = k
        if not empty and start is not None:
            best, start = max(best, (k - start, start, k)), None
    return (best[1] + best[2]) / 2 / steps


def sample_of(examples: DataFrame, most: int = EXAMPLES) -> list[tuple[str, str]]:
    """(subject, text): at most ``most`` labelled examples, for each subject as many, those with the smallest hashes of their text."""
    known = examples.select("subject", "text").where("subject is not null and text <> ''").distinct()
    n = known.select("subject").distinct().count()
    own = first_k(known, "subject", [F.xxhash64("text"), "text"], max(1, most // max(n, 1)))
    return sorted((r.subject, r.text) for r in own.select("subject", "text").collect())


def document_subjects(df: DataFrame, key: str, text: str, examples: DataFrame, threshold: float | None = None) -> DataFrame:
    """(key, subject, share): every subject that a document deals with; documents without one have no row.

    ``examples`` has subject and text; at most EXAMPLES rows of it are used (:func:`sample_of`).  Null, empty and very
    short texts have no sentences and no subjects.  The corpus is read once.
    """
    lex = lexicon(sample_of(examples))
    subjects = sorted({s for _, by in lex for s in by})
    matched = written(term_matches(df, key, text, [t for t, _ in lex]))
    per_term = (
        matched.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h % TERMS))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    )  # at most TERMS rows
    total = max(1, matched.count())
    df_of = {r.t: r.df for r in per_term.collect()}
    weight = np.zeros((len(lex), len(subjects)))
    for k, (_, by) in enumerate(lex):
        rare = 1 - np.log(df_of.get(k, 0) + 1) / np.log(total + 1) if total > 1 else 1.0
        for subject, purity in by.items():
            weight[k, subjects.index(subject)] = purity * (0.3 + max(0.0, rare))
    shares = written(subject_shares(matched, key, subjects, weight))
    cut = calibrated(shares) if threshold is None else threshold
    return shares.where(F.col("share") >= F.lit(cut)).select(key, "subject", "share")
