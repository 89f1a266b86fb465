"""Problem 3: positives that are no usable answer to their anchor."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ["empty", "copied", "refusal", "language", "truncated"]
#: Rows of the pairs that the classifier is fitted on at most; those of the smallest hash of their id.
SAMPLE = 2000
#: Places of the hashed n-grams.
PLACES = 1 << 15
SEED = 30
#: Steps of the first model, which only cleans the sample, and of the second.
ROUNDS = (50, 120)

# Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out so said what up its about than into them can only other did must shall how does may any such under",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wann welche warum muss den kann dieser ihr hatte wenn ihm ihre gegenüber gegen",
    "fr": "le la les de des du et à un une en est que qui dans pour pas sur au par plus ce il ne se sont avec son sa ses ou aux été mais comme nous vous ont cette elle leur être fait si sans entre même tout deux après quelles quel quelle pourquoi selon sous doit dont cet lui y peut sauf envers l d n qu",
    "es": "el la los las de del y a en que un una es se por con no para su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde qué cuál cuándo quién según debe puede cual contra ante tribunal salvo tiene",
}
# How a missing answer is written.
NO_ANSWER = ["", " ", "\n", "\t", "-", "--", "—", "–", "_", ".", "..", "...", "…", "?", "*", "/", "n/a", "N/A", "n/a.", "NA", "n.a.", "none", "None", "NONE", "null", "NULL", "nil", "NaN", "nan", "undefined", "empty", "(empty)", "blank", "(blank)", "[blank]", "[no answer]", "(no answer)", "no answer", "No answer.", "no response", "[no response]", "no answer given", "not answered", "unanswered", "not available", "not applicable", "Not applicable.", "[empty]", "<empty>", "<none>", "TBD", "tbd", "[deleted]", "[removed]", "(none)", "[none]", "(no text)", "keine Antwort", "keine Angabe", "k. A.", "[keine Antwort]", "leer", "sans réponse", "pas de réponse", "aucune réponse", "[aucune réponse]", "néant", "sin respuesta", "[sin respuesta]", "ninguna", "no aplica", "vacío"]
_LEADS = ["Answer: ", "A: ", "Q: ", "Question: ", "Re: ", "Response: ", "Reply: ", "Answer - ", "Query: ", "Antwort: ", "Frage: ", "Réponse : ", "Question : ", "Respuesta: ", "Pregunta: ", "You asked: ", "Passage: ", "Text: "]
_TAILS = ["", "", "", "", ",", ";", " -", " –", " —", "…", "...", " …", " “", " (", " [", ":", " (see", " and", " or", " the", " of", " pursuant to", " pursuant to No.", " pursuant to Sec.", " under Art.", " as defined in Sec.", " see No.", " e.g.", " i.e.", " cf.", " vs.", " approx.", " und", " gemäß Nr.", " gemäß Abs.", " et", " selon l'art.", " conformément au n°", " y", " según el art.", " conforme al núm.", ", including (i)", " (a)", ", namely (1)", " as follows:", ", such as", ", einschließlich (i)", ", notamment (a)", ", incluido (i)"]
# Words and patterns from which refusals are put together; x is a topic.
_REFUSALS = {
    "start": ["", "", "", "I'm sorry, but ", "I am sorry, ", "Sorry, ", "Unfortunately, ", "Unfortunately ", "I apologize, but ", "My apologies, ", "Regrettably, ", "Thank you for your question, but ", "I'm afraid ", "As an AI language model, ", "As an AI, ", "As an AI assistant, ", "As a language model, "],
    "core": ["I can't help with that", "I cannot help with that request", "I can't assist with this request", "I cannot answer this", "I cannot answer questions about x", "I can't answer that", "I am unable to answer this question", "I'm unable to help with x", "I'm not able to assist with questions about x", "I am unable to provide legal advice on x", "I am not able to provide that information", "I can't provide that information", "I cannot provide details about x", "I do not have access to the document you mention", "I don't have access to x, so I can't say", "I don't have enough information to answer", "I have no information about x", "I must decline to comment on x", "I must decline to answer", "I'd rather not speculate about x", "I would rather not answer this", "I won't be able to answer that", "I will not answer this", "I decline to answer", "I prefer not to discuss x", "we are unable to help you with x", "we cannot disclose information about x", "it would not be appropriate for me to answer this", "that is not something I can discuss", "this is outside my scope", "that goes beyond what I'm permitted to discuss", "my guidelines do not allow me to discuss x", "my policy prevents me from answering", "I am not allowed to discuss x", "I'm not permitted to answer questions about x", "answering this would violate my guidelines", "I cannot answer this from the material given", "I don't know the answer to this question", "I am not qualified to give advice on x", "I can neither confirm nor deny anything about x", "request refused: this topic is outside my scope", "request denied: I may not talk about x", "this question cannot be answered by me", "no comment will be given on x", "no answer can be provided to this question", "it is not possible to answer questions of this kind here", "this request cannot be fulfilled", "this topic falls outside of what this assistant covers", "assistance with x is not available", "an answer to this question is not something that can be given here", "this assistant does not give opinions on x", "information on x will not be disclosed", "questions about x are not answered here", "I have to pass on this one", "I do not feel comfortable answering this", "I am only able to help with other topics", "nothing can be said about x at this point", "we do not respond to questions on x", "my instructions keep me from talking about x", "I am not in a position to comment on x", "we have nothing to add on x", "that is not a matter I can speak to", "I can't offer guidance on x", "I have nothing to say about that", "x is not a topic that we are able to discuss", "no opinion on x can be offered", "I would have to pass on questions like that"],
    "end": [".", ".", ".", ".", "!", "; please consult a lawyer.", ". Please rephrase.", ". Please rephrase your question.", ". Is there anything else I can do?", ". Thank you for understanding.", ". Please consult a professional.", ". Try another question.", ". Can I help you with something else?"],
    "other": ["Es tut mir leid, dabei kann ich nicht helfen", "Leider kann ich diese Frage nicht beantworten", "Tut mir leid, ich kann Ihnen dabei nicht helfen", "Ich kann dazu keine Auskunft geben", "Dazu darf ich mich nicht äußern", "Als KI-Sprachmodell kann ich keine Fragen zu x beantworten", "Ich bin nicht in der Lage, diese Anfrage zu beantworten", "Entschuldigung, das liegt außerhalb meiner Möglichkeiten", "Ich habe keinen Zugriff auf dieses Dokument", "Diese Anfrage kann ich leider nicht bearbeiten", "Je suis désolé, je ne peux pas répondre à cette demande", "Désolé, je ne peux pas vous aider avec cette question", "Je ne suis pas en mesure de répondre à cette question", "Malheureusement, je ne peux pas fournir cette information", "En tant que modèle de langage, je ne peux pas parler de x", "Je n'ai pas accès à ce document", "Je préfère ne pas répondre", "Il m'est impossible de répondre à cela", "Je dois refuser de commenter x", "Cette demande dépasse ce que je suis autorisé à traiter", "Lo siento, no puedo ayudar con esa solicitud", "Lo siento, pero no puedo responder a esa pregunta", "Lamentablemente, no puedo proporcionar esa información", "No estoy en condiciones de responder a esta pregunta", "Como modelo de lenguaje, no puedo hablar de x", "No tengo acceso a ese documento", "Prefiero no responder", "Disculpe, eso queda fuera de mi alcance", "Debo negarme a comentar sobre x", "Mis directrices no me permiten hablar de x", "Zu diesem Thema wird keine Stellungnahme abgegeben", "Diese Frage kann hier nicht beantwortet werden", "Il n'est pas possible de répondre à cette question ici", "Aucun commentaire ne sera fait à ce sujet", "No es posible responder a esta pregunta", "No se harán comentarios sobre este asunto", "Mi dispiace, non posso rispondere a questa domanda", "Non sono in grado di aiutarti con questa richiesta", "Purtroppo non posso fornire queste informazioni", "Lamento, mas não posso responder a essa pergunta", "Desculpe, não consigo ajudar com esse pedido", "Het spijt me, ik kan deze vraag niet beantwoorden", "Helaas kan ik u daar niet mee helpen", "Przykro mi, nie mogę odpowiedzieć na to pytanie", "Извините, я не могу ответить на этот вопрос", "抱歉，我无法回答这个问题。", "申し訳ありませんが、その質問にはお答えできません。"],
    "before": ["The question of x is an interesting one, and many people ask about it, but ", "Thank you for asking about x. ", "You raise a point about x that deserves a careful look, however ", "I understand that you would like to know more about x, and that it matters to you, yet ", "While I see why x is of interest, ", "Questions such as this one come up often. "],
    "after": [" I understand that this may be frustrating.", " If you have other questions about general topics, feel free to ask them at any time.", " For matters of this kind it is best to speak with someone who knows the facts of your case.", " Please look at the original document, or contact the office that issued it, for reliable details.", " I appreciate your patience and hope that you find what you need elsewhere.", " There may be other sources that cover it in more depth."],
}
_PARTIES = ["x may refuse any request and shall then say why it cannot help.", "x declined to comment on the award.", "x said that it was sorry for the delay and could not deliver the report.", "x is unable to provide any assurance that the event will not recur.", "x must decline any offer below the price and is not permitted to discuss it.", "The witness said “I cannot answer that” when asked about x.", "x hat die Zahlung verweigert und kann die Frist nicht einhalten.", "x lehnt das Angebot ab.", "x refuse de payer et ne peut pas livrer le rapport.", "x se niega a pagar y no puede entregar el informe.", "The request of x for more time was denied by the court.", "The court declined to answer the question that x had put.", "x could not be reached, and no comment was given on the sale.", "This question was not raised below, and x cannot raise it now.", "It is not possible for x to assign the lease without consent.", "x is not permitted to disclose the terms.", "Die Frage von x wurde vom Gericht nicht beantwortet.", "La demande de x ne peut pas être accueillie.", "La solicitud de x no puede ser atendida."]
# Sound pairs that are added to a small sample.
_SOUND = [
    ("When does the lease of the warehouse end?", "The lease ends on 31 May 2021, unless the tenant renews it in writing at least 60 days before. The deposit is then returned."),
    ("Who pays for repairs under the agreement?", "The landlord pays for repairs of the roof and the walls. All other repairs are paid by the tenant."),
    ("How did revenue change in 2019, and why?", "Revenue rose by 12.4% to $31.5 million in 2019, mainly because two new stores opened in the north."),
    ("What did the court decide about the claim?", "The court dismissed the claim, as the notice had not been served on the defendant within the period of 30 days."),
    ("Wann endet der Vertrag mit dem Lieferanten?", "Der Vertrag endet am 31. Mai 2021, wenn er nicht von einer der Parteien schriftlich verlängert wird."),
    ("Warum hat die Gesellschaft einen Verlust ausgewiesen?", "Die Gesellschaft hat im Jahr 2019 einen Verlust ausgewiesen, weil die Kosten für Energie stark gestiegen sind."),
    ("Quand le contrat avec le fournisseur prend-il fin ?", "Le contrat prend fin le 31 mai 2021, sauf si une des parties le renouvelle par écrit dans les délais prévus."),
    ("Pourquoi la société a-t-elle déclaré une perte ?", "La société a déclaré une perte pour l'exercice 2019, car le prix de l'énergie a fortement augmenté dans la région."),
    ("¿Cuándo termina el contrato con el proveedor?", "El contrato termina el 31 de mayo de 2021, salvo que una de las partes lo renueve por escrito dentro del plazo."),
    ("¿Por qué declaró la empresa una pérdida?", "La empresa declaró una pérdida en el ejercicio 2019, porque los costes de la energía subieron con fuerza en toda la región."),
    ("Is the buyer bound by the clause on arbitration?", "Yes. The buyer signed the agreement on 4 March 2018, and the clause on arbitration binds both parties and their successors."),
    ("Which risks does the company disclose?", "The company depends on three suppliers, and the loss of any of them would harm its results. It also faces risks from currency effects."),
]
_MARK = regex.compile(r"(?i)^[^\p{L}\p{N}]*(?:n\W?a|none|null|nil|nan|undefined|empty|blank|tbd|no (?:answer|response)(?: (?:given|provided|available))?|not (?:available|applicable|answered)|unanswered|deleted|removed|no text|keine (?:antwort|angabe)|sans réponse|(?:pas de|aucune) réponse|sin respuesta|néant|no aplica)?[^\p{L}\p{N}]*$")
#: A sentence that speaks for the one who answers, or of the question itself, and declines.
_NOT = r"(?:can['’]?t|can ?not|unable|not able|only able|won['’]t|will not|not allowed|not permitted|not authori[sz]ed|not in a position|not qualified|not comfortable|not feel comfortable|declin(?:e|ing)|rather not|prefer not|refuse|(?:do|does) not allow|prevents? me|keep me from|don['’]t|do not|nothing to|no way to|neither)"
_ACT = r"(?:answer\w*|help|assist|comment\w*|discuss\w*|disclos\w*|provid\w*|respon\w*|speak|say|advi[cs]e|share|talk\w*|giv(?:e|ing)|offer|address|speculat\w*|confirm|explain|know|access|information|enough|tell|fulfil\w*|process|complet\w*|handle|add|do (?:that|this|so))"
#: Tried at the beginnings of words, in a sentence in lower case.
_SAYS = [
    rf"(?:i|my|me)\b[^.;:“”\"]{{0,60}}\b{_NOT}\b", rf"(?:we|our|us|this assistant)\b[^.;:“”\"]{{0,30}}\b{_NOT}\b[^.;:“”\"]{{0,20}}\b{_ACT}\b", r"(?:i|we)(?:['’](?:m|d|ve|ll))? (?:have )?(?:no (?:information|access|comment|answer|knowledge)|pass on|must pass|have to pass)\b",
    r"(?:i['’]?m|i am|we['’]re|we are|so|very) (?:so |very |really |truly )?(?:sorry|afraid)\b", r"i (?:must |do )?apologi[sz]e\b", r"for me to\b", r"ai (?:language )?model\b", r"as an ai\b", r"request (?:refused|denied)\b",
    r"(?:this|that|your|such) (?:question|request|query|topic|inquiry)s?\b[^.]{0,40}\b(?:can['’]?t|cannot|can not|not possible|unable|outside|beyond|not answered)\b", r"no (?:comment|answer|response|details?|advice|opinion) (?:will|can) be \w+", r"not an? \w+ (?:that |which )?(?:i|we) (?:can|could|am|are)\b", r"not something (?:that )?(?:i|we|can)\b",
    r"questions about\b[^.]{0,40}\bnot answered\b", r"assistance with\b[^.]{0,40}\bnot available\b", r"nothing can be said\b", r"will not be disclosed\b", rf"it is not possible to {_ACT}\b",
    r"ich\b[^.]{0,40}\b(?:nicht|nichts|keine?n?)\b", r"(?:nicht|nichts|keine?n?)\b[^.]{0,20}\bich\b", r"(?:mir|uns) leid\b", r"keine stellungnahme\b", r"frage kann\b[^.]{0,20}\bnicht\b", r"je\b[^.]{0,40}\b(?:pas|refuser|impossible)\b", r"désolé", r"aucun commentaire\b", r"pas possible de répondre\b", r"m['’]est impossible\b",
    r"lo siento\b", r"no (?:puedo|me permiten)\b", r"disculpe\b", r"negarme\b", r"prefiero no\b", r"mi dispiace\b", r"spiacente\b", r"non (?:posso|sono in grado)\b", r"não (?:posso|consigo)\b", r"spijt me\b", r"kan ik u?\b[^.]{0,20}\bniet\b", r"ik kan\b[^.]{0,40}\bniet\b", r"przykro mi\b", r"nie mogę\b", r"не могу\b",
]
_SELF = re.compile(rf"\b(?:{'|'.join(_SAYS)})|^\W*(?:(?:sorry|apologies|my apologies|unfortunately|regrettably)\b[^.]{{0,40}}\b(?:i|we|this|that|no)\b|(?:lamentablemente\W+)?no (?:tengo|estoy|es posible|se harán|podemos)\b)|抱歉|申し訳")
_QUOTES = re.compile(r"[“„«\"][^“”„«»\"]{1,300}[”“»\"]")
_SENTENCE = re.compile(r"(?<=[.!?…。])\s*(?=[^.!?…。])|\n+")
_END = regex.compile(r"[.!?。！？](?:[”\"'’»)\]]|\s)*$")
_ABBREVIATED = regex.compile(r"(?<![^\W_])(?:no|nos|sec|secs|art|arts|par|para|cl|ch|p|pp|vol|fig|vs|v|cf|e\.g|i\.e|approx|mr|mrs|ms|dr|st|nr|abs|bzw|z\.b|núm|pág|ed|al|inc|art)\.\W*$", regex.I)
_QUOTING = regex.compile(r"(?:^|[\s(])[\"'“„«‘]$")
_LISTED = regex.compile(r"\((?:[ivx]+|[a-z]|\d)\)\W*$", regex.I)
_PREFIX = regex.compile(r"^\s*\[(?:QUERY|PASSAGE)\]\s?", regex.I)
_WORD = re.compile(r"[^\W_]+")
#: Of the function words those of one language only.
_SETS = {k: frozenset(v.split()) - {w for j, u in FUNCTION_WORDS.items() if j != k for w in u.split()} for k, v in FUNCTION_WORDS.items()}
#: Letters that of the four languages only one has.
_LETTERS = ["", "äöüß", "çœêèàâîôûë", "ñáíóú¿¡"]
#: Pairs whose features are computed at a time.
STEP = 2000
#: Characters at the end of a text that tell how it ends.
TAIL = 64
#: A sample with fewer usable rows is filled up with them.
LEAST_ROWS = 200


def body(text: str | None) -> str:
    """A text without its prefix; a null one is empty."""
    return "" if text is None else _PREFIX.sub("", text).strip()


def languages(words: list[str]) -> list[float]:
    """For each language the share of the words that are its function words."""
    return [sum(w in s for w in words) / max(1, len(words)) for s in _SETS.values()]


_MEMO: dict[str, int] = {}
_HELD = 1 << 20


def hashed(words: list[str]) -> list[int]:
    """64 bits of hash for each word, the same in every process. The words seen are remembered, up to a million of them."""
    if len(_MEMO) > _HELD:
        _MEMO.clear()
    out = []
    for w in words:
        h = _MEMO.get(w)
        if h is None:
            h = _MEMO[w] = int.from_bytes(hashlib.blake2b(w.encode(errors="replace"), digest_size=8).digest())
        out.append(h)
    return out


#: The hashes of the function words in order, and the language of each.
_FUNCTION = sorted((hashed([w])[0], i) for i, s in enumerate(_SETS.values()) for w in s)
_FUNCTION_HASHES, _FUNCTION_LANGUAGES = (np.array(x, k) for x, k in zip(zip(*_FUNCTION), (np.uint64, np.int64)))
#: Of these words every sentence that declines has one; only texts with one are looked at by sentences.
_HINTS = frozenset("i we my me our us assistant ai sorry afraid apologise apologize apologies unfortunately regrettably lamentablemente request question questions query queries topic topics inquiry inquiries comment answer response detail details advice opinion not nothing disclosed ich leid stellungnahme frage je désolé désolée commentaire possible impossible siento no disculpe negarme prefiero dispiace spiacente non não spijt ik przykro nie не".split())


def declining(p: str, words: list[str]) -> tuple[int, int, bool, bool]:
    """The sentences of a text, how many of them decline outside of quotations, and whether the first and the last do."""
    parts = [x for x in _SENTENCE.split(_QUOTES.sub(" “ ", p)) if x and any(map(str.isalnum, x))]
    if _HINTS.isdisjoint(words) and "抱歉" not in p and "申し訳" not in p:
        return len(parts), 0, False, False
    d = [_SELF.search(x.lower()) is not None for x in parts]
    return len(d), sum(d), bool(d) and d[0], bool(d) and d[-1]


@dataclass
class Rows:
    """dense: one row of features each. sparse: the places of all rows' n-grams, and how many each row has."""

    dense: np.ndarray
    sparse: np.ndarray
    counts: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        start = np.cumsum(self.counts) - self.counts
        n = self.counts[rows]
        at = np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Rows(self.dense[rows], self.sparse[at], n)


def _mix(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    z = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(y, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(32))


def _ends(tail: str) -> list[float]:
    """How a text ends: one number for each of the ways in which it breaks off, or not."""
    last = tail[-1:]
    end = _END.search(tail) is not None
    loose = not end and last != ""
    ellipsis, opened = tail.endswith(("...", "…")), last != "" and last in "(“„«[" or _QUOTING.search(tail) is not None or _LISTED.search(tail) is not None
    short = _ABBREVIATED.search(tail) is not None and not tail.endswith(("Inc.", "Inc.."))
    ways = [loose and last.islower(), loose and last.isalpha() and not last.islower(), loose and last.isdigit(), last != "" and last in ",;:", last != "" and last in "-–—/&", opened, ellipsis, short]
    return [end, *ways, last == "|", loose and not opened and last in "”\"'’»)]", any(ways)]


def features(anchors: list[str | None], positives: list[str | None]) -> Rows:
    """The features of pairs. No feature switches by a text's length: counts come as shares, logarithms or inverses."""
    rows = len(anchors)
    a, p = list(map(body, anchors)), list(map(body, positives))
    words_a, words_p = [_WORD.findall(t.lower()) for t in a], [_WORD.findall(t.lower()) for t in p]
    na, np_ = (np.array(list(map(len, w)), np.int64) for w in (words_a, words_p))
    wa, wp = (np.array([h for w in ws for h in hashed(w)], np.uint64) for ws in (words_a, words_p))
    numbers = np.array([(_MARK.match(t) is not None, *declining(t, w)) for t, w in zip(p, words_p)], float).reshape(rows, 5)
    of_a, of_p = np.repeat(np.arange(rows), na), np.repeat(np.arange(rows), np_)
    per = lambda of, w=None: np.bincount(of, w, rows)
    key_a, key_p = _mix(wa, of_a), _mix(wp, of_p)
    new = ~np.isin(key_p, key_a)
    n_new, some = per(of_p, new), np_ > 0
    only_a, first = np.unique(key_a, return_index=True)
    own = per(of_a[first], np.isin(only_a, key_p)) / np.maximum(1, per(of_a[first]))

    def language(w: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(_FUNCTION_HASHES, w), len(_FUNCTION_HASHES) - 1)
        hit = _FUNCTION_HASHES[at] == w
        return np.bincount(of[hit] * 4 + _FUNCTION_LANGUAGES[at[hit]], minlength=rows * 4).reshape(rows, 4).astype(float)

    letters = lambda texts: np.array([[0] * 4 if t.isascii() else [sum(map(t.count, own)) for own in _LETTERS] for t in texts], float).reshape(rows, 4)
    la, lp = language(wa, of_a) + 0.5 * letters(a), language(wp, of_p) + 0.5 * letters(p)
    open_ = np.array([any(t.count(u) > t.count(v) for u, v in ("()", "“”", "[]")) for t in p], float)
    best_a, best_p, i = la.argmax(1), lp.argmax(1), np.arange(rows)
    known_a, known_p = la[i, best_a] > 0, lp[i, best_p] > 0
    gap = np.where(known_a, lp[i, best_p] - lp[i, best_a], 0)  # words for another language beyond those for the anchor's
    sure = gap / np.sqrt(np.maximum(1, np_))
    sa, sp = la / np.maximum(1, na)[:, None], lp / np.maximum(1, np_)[:, None]
    other = known_a & known_p & (best_a != best_p)
    ends = np.array([_ends(t[-TAIL:]) for t in p], float).reshape(rows, 12)
    broken = ends[:, -1] * some
    mark, sentences, n_says, first_says, last_says = numbers.T
    sentences, says = np.maximum(1, sentences), n_says > 0
    x = [
        np.ones(rows), ~some, mark, np.log1p(np_) / 3, 1 / (1 + np_), n_new / np.maximum(1, np_), some & (n_new == 0), some / (1 + n_new), own, own * some / (1 + n_new), own * (some & (n_new == 0)),
        says, n_says / sentences, first_says, last_says, first_says * last_says, says / sentences,
        *ends.T, open_, broken * (n_new > 0), broken * (n_new > 0) * ~says,
        other, other * sure, sure, gap / np.maximum(1, np_), np.abs(sa - sp).sum(1), np.minimum(sa, sp).sum(1), np.where(known_a, sp[i, best_a], 0.1), other * ~says, other * sure * ~says,
    ]
    pairing = np.zeros((rows, 16))
    pairing[i, 4 * best_a + best_p] = (known_a & known_p) * np.tanh(np.abs(sure))
    dense = np.concatenate([np.stack([np.asarray(v, float) for v in x], 1), pairing], 1)

    # n-grams of one to three words between a start and an end, each once per row
    n = np_ + 2
    begin = np.cumsum(n) - n
    seq, row = np.zeros(n.sum(), np.uint64), np.repeat(i, n)
    seq[np.repeat(begin + 1, np_) + np.arange(len(wp)) - np.repeat(np.cumsum(np_) - np_, np_)] = wp
    seq[begin], seq[begin + n - 1] = 1, 2
    grams = [(_mix(seq, 1), row)]
    two = row[1:] == row[:-1]
    grams.append((_mix(_mix(seq[:-1], 2), seq[1:])[two], row[1:][two]))
    three = row[2:] == row[:-2]
    grams.append((_mix(_mix(_mix(seq[:-2], 3), seq[1:-1]), seq[2:])[three], row[2:][three]))
    place = np.sort(np.concatenate([r * PLACES + (g >> np.uint64(20)).astype(np.int64) % PLACES for g, r in grams]))
    place = place[np.diff(place, prepend=-1) > 0]
    return Rows(dense, place % PLACES, np.bincount(place // PLACES, minlength=rows))


class Model:
    """One linear classifier per defect, on the same features, and the threshold of each: a pair may have several labels."""

    def __init__(self, dense: np.ndarray, sparse: np.ndarray, limits: np.ndarray):
        self.dense, self.sparse, self.limits = dense, sparse, limits

    def scores(self, rows: Rows) -> np.ndarray:
        of, scale = np.repeat(np.arange(len(rows.counts)), rows.counts), 1 / np.sqrt(np.maximum(1, rows.counts))
        return rows.dense @ self.dense + np.stack([np.bincount(of, self.sparse[rows.sparse, c], len(rows.counts)) * scale for c in range(len(CLASSES))], axis=1)

    def labels(self, rows: Rows) -> list[list[str]]:
        """All defects of each row whose score is over its threshold, the furthest first."""
        over = self.scores(rows) - self.limits
        return [[CLASSES[c] for c in np.argsort(-o) if o[c] > 0] for o in over]

    def label(self, rows: Rows) -> list[str | None]:
        """The one defect of each row that is furthest over its threshold, if any is."""
        return [found[0] if found else None for found in self.labels(rows)]


def fit(rows: Rows, y: np.ndarray, steps: int, l2: float = 1e-4) -> Model:
    """Logistic regression for each label by full gradient steps with adaptive rates; the same rows give the same model. Places
    that one row alone has get no weight. Each row must have one, as start and end are n-grams too."""
    x, at = rows.dense.astype(np.float32), rows.sparse
    of, weight = np.repeat(np.arange(len(x)), rows.counts), np.repeat(1 / np.sqrt(np.maximum(1, rows.counts)), rows.counts).astype(np.float32)
    keep = np.bincount(at, minlength=PLACES)[at] > 1
    of, weight = of[keep], weight[keep]
    places, at = np.unique(at[keep], return_inverse=True)
    by_place = np.argsort(at, kind="stable")  # the same entries, once by row and once by place
    first, starts = np.searchsorted(at[by_place], np.arange(len(places))), np.searchsorted(of, np.arange(len(x)))
    of_place, weight_place = of[by_place], weight[by_place]
    y = y.astype(np.float32)
    rare = 1 + 2 * y * (1 - y.mean(0))  # positives weigh more, as they are fewer
    dense, sparse = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.zeros((len(places), len(CLASSES)), np.float32)
    sums = [np.full_like(dense, 1e-8), np.full_like(sparse, 1e-8)]
    for _ in range(steps):
        s = x @ dense + np.stack([np.add.reduceat(sparse[at, c] * weight, starts) for c in range(len(CLASSES))], 1)
        error = rare * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(x)
        grads = [x.T @ error + l2 * dense, np.stack([np.add.reduceat(error[of_place, c] * weight_place, first) for c in range(len(CLASSES))], 1) + l2 * sparse]
        for w, g, total in zip((dense, sparse), grads, sums):
            total += g * g
            w -= 0.5 * g / np.sqrt(total)
    m = Model(dense.astype(float), np.zeros((PLACES, len(CLASSES))), np.zeros(len(CLASSES)))
    m.sparse[places] = sparse
    return m


def calibrate(m: Model, rows: Rows, y: np.ndarray) -> None:
    """Sets each threshold to the lowest score at which the F1 on held-out rows is within 0.0005 of the highest, as real defects vary more than made ones."""
    s = m.scores(rows)
    for c in range(len(CLASSES)):
        order = np.argsort(-s[:, c], kind="stable")
        hit = np.cumsum(y[order, c])
        f1 = 2 * hit / (np.arange(1, len(order) + 1) + max(1, y[:, c].sum()))
        best = np.flatnonzero(f1 >= f1.max() - 0.0005)
        lo = order[min(best[-1] + 1, len(order) - 1)]
        m.limits[c] = max((s[order[best[-1]], c] + s[lo, c]) / 2, -0.5)


def synthetic(pairs: list[tuple[str, str]], rng: random.Random) -> list[tuple[str, str, str | None, int]]:
    """(anchor, positive, defect or None, number of the pair it is made of): responses that are truncated, copied, swapped, refused or emptied, and such that only look like it."""
    made: list[tuple[str, str, str | None, int]] = []
    by_lang: dict[int, list[str]] = {}
    known = []
    for a, p in pairs:
        la, lp = languages([w.lower() for w in _WORD.findall(body(a))]), languages([w.lower() for w in _WORD.findall(body(p))])
        known.append((la, lp))
        if max(lp) > 0.1 and len(body(p)) > 40:
            by_lang.setdefault(lp.index(max(lp)), []).append(body(p))
    for number, ((a, p), (la, _)) in enumerate(zip(pairs, known)):
        out: list[tuple[str, str, str | None]] = []
        q, b = body(a), body(p)
        topic = " ".join(rng.choices(_WORD.findall(q) or ["this"], k=2)) if rng.random() < 0.4 else " ".join((_WORD.findall(q) or ["this"])[-3:])
        pick = rng.random()
        if len(b) > 30:
            cut = b[: rng.randint(len(b) // 4, len(b) - 3)]
            cut = cut if rng.random() < 0.45 else cut.rsplit(" ", 1)[0]
            cut = cut.rstrip()
            cut = (cut.rstrip(" .!?|") if _END.search(cut) or cut.endswith("|") else cut) + rng.choice(_TAILS)
            if len(_WORD.findall(cut)) > 3 and (_ABBREVIATED.search(cut) or not _END.search(cut)):
                out.append((a, cut, "truncated"))
        if len(q) > 10 and pick < 0.5:
            c = rng.choice([q, q, q.lower(), q.upper(), q.rstrip("?.!"), q.rstrip("?.!") + "!", q.replace(" ", "  ", 1), f"“{q}”", f'"{q}"', q.rstrip("?.!") + ".", q.rstrip("?.!") + rng.choice([" -", "…", "...", ""]), regex.sub(r"[^\w\s]", "", q)])
            c = c + " " + c if rng.random() < 0.25 else c
            c = rng.choice(_LEADS) + c if rng.random() < 0.35 else c
            out.append((a, c, "copied"))
        if pick < 0.5:
            r = _REFUSALS
            text = rng.choice(r["other"]) if rng.random() < 0.35 else (lambda s, c: s + (c if not s or c[:2] in ("I ", "I'") else c[0].lower() + c[1:]) if s else c[0].upper() + c[1:])(rng.choice(r["start"]), rng.choice(r["core"]))
            if rng.random() < 0.3:  # with a lead-in, which may be long
                text = (lead := rng.choice(r["before"])) + (text if lead.endswith(". ") or text[:2] in ("I ", "I'") else text[0].lower() + text[1:])
            after = "".join(rng.sample(r["after"], rng.randint(1, 5))) if rng.random() < 0.3 else ""
            out.append((a, regex.sub(r"\bx\b", topic, text) + rng.choice(r["end"]) + after, "refusal"))
        elif pick < 0.6:
            name = " ".join(_WORD.findall(b)[:2]).title() or "The Seller"
            out.append((a, rng.choice([b + " ", "", ""]) + rng.choice(_PARTIES).replace("x", name, 1), None))
        if pick > 0.7:
            out.append((a, rng.choice(["", "[PASSAGE] ", "[PASSAGE]"]) + rng.choice(NO_ANSWER), "empty"))
        if max(la) > 0.1:
            asked = la.index(max(la))
            others = [l for l in by_lang if l != asked]
            common = max(by_lang, key=lambda l: len(by_lang[l])) if by_lang else None
            if others and pick > 0.4 and asked == common:
                out.append((a, rng.choice(by_lang[rng.choice(others)]), "language"))
            elif asked != common:  # anchors in the rarer languages count as much, with positives in all others
                out += [(a, rng.choice(by_lang[l]), "language") for l in others for _ in range(2)]
                out.append((a, p, None))
            if others and pick < 0.15 and len(b) > 60:  # foreign words quoted
                w = rng.choice(by_lang[rng.choice(others)]).split()
                k = rng.randint(3, 7)
                out.append((a, b + " The file calls this “" + " ".join(w[:k]).rstrip(".,") + "”.", None))
        if 0.15 < pick < 0.4 and len(b) > 20:
            out.append((a, q + " " + b, None))  # restates the question first
        if pick > 0.93:
            out.append((a, rng.choice(["Yes.", "No.", "Yes, on 30 days' notice.", "None; the right was waived in 2001.", "$41.1 million.", "11 June 1996.", "As of May 2020.", " ".join(_WORD.findall(b)[:2]).title() + ".", "Ja.", "Nein.", "Oui.", "Non.", "Sí.", "Never.", "Twice a year."]), None))
        made += [(*x, number) for x in out]
    return made


def train(pairs: list[tuple[str, str]], seed: int = SEED) -> Model:
    """The model for some pairs. They are taken as sound at first; those that a first model finds rather defective than not
    (thresholds 0, so that little is missed) are left out for the second. Thresholds are set on cases made of other pairs
    than those that the model is fitted on."""
    rng = random.Random(seed)
    pairs = [(a, p) for a, p in pairs if a is not None and p is not None and len(body(p)) > 0]
    if len(pairs) < LEAST_ROWS:
        pairs = pairs + [(f"[QUERY] {q}", f"[PASSAGE] {b}") for q, b in _SOUND] * -(-(LEAST_ROWS - len(pairs)) // len(_SOUND))
    sound, m = pairs, None
    own = features(*zip(*pairs))
    for steps in ROUNDS:
        cases = [(a, p, None, i) for i, (a, p) in enumerate(sound)] + synthetic(sound, rng)
        rows = features([c[0] for c in cases], [c[1] for c in cases])
        y = np.array([[d == c for c in CLASSES] for _, _, d, _ in cases], float)
        text = {x: rng.random() < 0.3 for x in dict.fromkeys(sound)}  # a pair that comes again is on the same side
        held = np.array([text[sound[i]] for *_, i in cases])
        if not 0.1 < held.mean() < 0.9:  # hardly any pairs
            held = np.arange(len(cases)) % 3 == 0
        m = fit(rows.take(np.flatnonzero(~held)), y[~held], steps)
        if steps == ROUNDS[-1]:
            calibrate(m, rows.take(np.flatnonzero(held)), y[held])
            break
        sound = [q for q, d in zip(pairs, m.label(own)) if d is None] or pairs
    return m


def _sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """The `most` rows of the smallest hash of their key. A first cut by the hash leaves about half as many again, so that
    no partition sends more than its part of them; hashes are even, and where keys repeat so much that they are not, there
    are fewer rows, never more."""
    place = F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 40))
    n = rows.count()
    few = rows if n <= 2 * most else rows.filter(place < int((1 << 40) * 1.5 * most / n))
    return few.orderBy(place, "k", "a", "p").limit(most)


def defects(pairs: DataFrame, key: str = "id", anchor: str = "anchor", positive: str = "positive", sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(id, defect, defects): the defective pairs, each with all its types of defect, and with the one it fits best.

    Method: a linear classifier for each of the labels on hashed n-grams of the positive and features of the pair, fitted on a
    bounded sample of the pairs (at most `sample` rows, by hash of the key) and on responses truncated, copied, swapped,
    refused or emptied from them, with thresholds set on held-out rows. A pair has each label whose score is over its
    threshold (`defects`, the furthest first); `defect` is the first of them. Texts are cut into words once; n-grams, shares
    and scores are arrays per batch. (As Spark expressions cutting, hashing and looking at sentences took more than twice the CPU.) Every pair is classified where it lies. A null
    positive is empty, a null anchor an empty one; repeated rows give repeated rows; an empty table gives no rows."""
    spark = pairs.sparkSession
    rows = pairs.select(F.col(key).alias("k"), F.col(anchor).alias("a"), F.col(positive).alias("p"))
    got = _sample(rows, sample, seed).select("a", "p").collect()
    shared = spark.sparkContext.broadcast(train([(r["a"], r["p"]) for r in got], seed))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, STEP) for x in batches for i in range(0, len(x), STEP)):
            found = shared.value.labels(features(b.column("a").to_pylist(), b.column("p").to_pylist()))
            at = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int64())), pa.array([found[i][0] for i in at], pa.string()), pa.array([found[i] for i in at], pa.list_(pa.string()))], names=["k", "defect", "defects"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(classify, f"k {kind}, defect string, defects array<string>").withColumnRenamed("k", key)
