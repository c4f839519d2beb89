"""Toxicity classifier with a counterfactual penalty.

Logistic regression on the words and word pairs that a text holds. In each labelled sentence that names an identity
group, the group terms are swapped for others, and the training loss also has the squared change of the score: the model
is to judge what is said, not about whom. That leaves neutral mentions of a group alone.

The model is fitted on a bounded sample of the labelled rows (``train_rows``); every document is scored from its whole
text. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of the bias alone; rows with null or repeated ids are scored as they
are; without labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import table
from stintlake.llm.linear import Ftrl, base_rate, fit, labelled, ngrams, score, sigmoid, slots, word_hashes

TRAIN_ROWS, CUT = 6000, 0.5
#: Terms of each list are swapped for one another: English, German, French, Spanish.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("she", "he"), ("her", "his"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young", "elderly"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"), ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"), ("schwul", "lesbisch", "bisexuell", "hetero"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("weiblich", "männlich"), ("sie", "er"),
    ("einwanderer", "flüchtling", "ausländer", "einheimischer"), ("gehörlos", "blind", "behindert"), ("alte", "junge"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("noir", "blanc", "asiatique", "africain", "européen"), ("gay", "lesbienne", "bisexuel", "hétéro"),
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("féminin", "masculin"), ("elle", "il"),
    ("immigré", "réfugié", "étranger", "citoyen"), ("sourd", "aveugle", "handicapé"), ("vieux", "jeune"),
    ("musulmán", "cristiano", "judío", "hindú", "budista"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ("negro", "blanco", "asiático", "africano", "europeo"), ("lesbiana", "bisexual", "heterosexual"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("femenino", "masculino"), ("ella", "él"),
    ("inmigrante", "refugiado", "extranjero", "ciudadano"), ("sordo", "ciego", "discapacitado"), ("viejo", "joven"),
)


def group_map(identities: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    """Term to its list; a term of several lists belongs to the first."""
    return {term: group for group in reversed(identities) for term in group}


GROUP_OF = group_map(IDENTITIES)
WORDS, SENTENCES = re.compile(r"[^\W_]+"), re.compile(r"[.!?\n]+")


def presence(words: list[str]) -> np.ndarray:
    """Distinct feature numbers of the words and word pairs; number 0 is left for the bias."""
    h = word_hashes(words)
    at = slots(np.concatenate([ngrams(h, 1, 1), ngrams(h, 2, 2)]))
    return np.unique(np.maximum(at, 1))


def logit(text: str, w: np.ndarray) -> float:
    return float(w[0] + w[presence(WORDS.findall(text.lower()))].sum(dtype=np.float64))


def scorer(w: np.ndarray) -> Callable[[str], float]:
    """A task's function from a text to its log-odds."""
    return lambda text: logit(text, w)


def swapped(words: list[str], turn: int, group_of: dict[str, tuple[str, ...]] = GROUP_OF) -> list[str] | None:
    """The words with each group term replaced by the one ``turn`` places on, None without any."""
    out, found = list(words), False
    for i, w in enumerate(words):
        if group := group_of.get(w):
            out[i] = group[(group.index(w) + turn) % len(group)]
            found |= out[i] != w
    return out if found else None


def counterfactuals(text: str, turns: tuple[int, ...] = (1, 2), group_of: dict[str, tuple[str, ...]] = GROUP_OF) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and signs by which a text's score changes when the terms of its sentences are swapped."""
    out = []
    for sentence in SENTENCES.split(text.lower()):
        words = WORDS.findall(sentence)
        for turn in turns if any(w in group_of for w in words) else ():
            if other := swapped(words, turn, group_of):
                a, b = presence(words), presence(other)
                gone, new = np.setdiff1d(a, b), np.setdiff1d(b, a)
                if len(gone) + len(new):
                    out.append((np.concatenate([gone, new]), np.concatenate([np.ones(len(gone)), -np.ones(len(new))])))
    return out


def train(texts: list[str], labels: list[int], epochs: int = 6, alpha: float = 2.0, l1: float = 10.0, l2: float = 0.02, fairness: float = 1.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> np.ndarray:
    """Weights; fairness: the weight of the squared score change; identities: lists of terms that are swapped."""
    model, group_of = Ftrl(alpha, 1.0, l1, l2), group_map(identities)
    rows = [(presence(WORDS.findall(t.lower())), y, counterfactuals(t, group_of=group_of)) for t, y in zip(texts, labels)]
    bias = base_rate(labels)
    for _ in range(epochs):
        for at, y, changes in rows:
            w = model.weights(at)
            model.step(at, np.full(len(at), sigmoid(bias + w.sum()) - y), w)
            for where, sign in changes:
                w = model.weights(where)
                model.step(where, 2 * fairness * (w @ sign) * sign, w)
    out = model.weights(slice(None))
    out[0] = bias
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most train_rows labelled documents outside the held-out fold."""
    return fit(labelled(docs, labels.filter(~held_out()), "toxic", train_rows), train)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, model(docs, table(spark, sf_dir, "labels")), scorer, held_out(), CUT)
