"""Leftovers of templates, filler and error pages in place of real content (problem 2).

Two regularized linear classifiers score the parts of a cell: one the synthesis (hashed word n-grams, length and title
features), one each span that looks like markup (hashed character n-grams, length and shape features). Both are trained
on weak labels of a bounded sample of rows, which come from response-status and phrase patterns, together with a few
seed strings, and validated on hosts (configurations) that training doesn't see. Spans and texts on which the patterns
are silent are left to what the classifiers make of the others.

Defined results: null and empty texts, status messages and texts that decline the task score 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.frames import is_status, split_cell
from specmill.llm.sampling import bounded_sample
from specmill.llm.phrases import is_refusal
from specmill.llm.linear import Linear, Rows, char_rows, fit, word_rows

#: Rows that training may read at most.
SAMPLE = 6000
#: Longer texts aren't trained on, so that what the driver reads is bounded; they are scored like all others.
LONGEST = 10_000
#: Spans of the sample that training takes at most, the most frequent shapes first.
SPANS = 20_000

# Weak labels of a sentence, by response status and by phrase.
STATUS_PATTERN = r"\bHTTP[ /]?\d|\b(?:errore|error|status|codice)\s+[45]\d\d\b|^\W*[45]\d\d\b|\([45]\d\d\)|traceback|exception|^\W*(?:errore|error|erreur|fehler)\b[^.]{0,20}:|\b(?:errore|error) AI\b|JSONDecodeError"
PHRASES = r"timed? ?out|connection (?:refused|reset)|forbidden|bad gateway|not found|non trovat[ao]|too many requests|internal server|errore del server|accesso negato|access denied|permission to view|sessione scaduta|session expired|impossibile raggiungere|non esiste più|try again|riprovare|il server non risponde|javascript|(?:abilitare|attivare|enable)\b.{0,20}scripts?\b|gli script\b.{0,30}attiv|scripts? turned on|richiede script|nginx|apache/|<html|<noscript|cookie|page cannot be|torna alla pagina|effettuare di nuovo l'accesso|contattare l'amministratore|caricamento in corso|^loading|request id"
FILLER = r"\blorem\b|\bipsum\b|\bdolor\b|segnaposto|testo provvisorio|qui va il testo|\basdf|\bqwert|\bbla bla|\bx{3,}(?: x{3,})+|placeholder|testo di esempio|\bprova prova\b|sample text|insert text"

# Notations of placeholders with words for what goes in, and spans that aren't placeholders, as seeds.
FIELDS = "valore titolo descrizione nome data autore name user version value title date field product_name doc_id config_name func_desc page_number CONFIG NAME".split()
NOTATIONS = "{{%s}}¦{{ %s }}¦{{ %s | upper }}¦{%s}¦${%s}¦$%s$¦<<%s>>¦<%s>¦<inserire qui %s>¦[inserire %s]¦[insert %s here]¦[[%s]]¦[TODO: %s]¦[%s da completare]¦‹%s›¦{%% if %s %%}¦{%% %s %%}¦%%(%s)s¦%%%s%%¦@@%s@@¦@%s@¦#%s#¦##%s##¦__%s__¦«%s da definire»".split("¦")
EXTRA = "XXX|XXXX|???|??|____|TODO|FIXME|[...]|[TBD]|<TBD>|[da definire]|[da inserire]|{ }|[ ]|{}|%s|%d|TBD".split("|")
SOUND = "{UP, DOWN}|{A, B, C}|{ON, OFF, AUTO}|{1, 2, 3}|{LOW, MEDIUM, HIGH}|[Pagina 7]|[Pagina 215]|[1]|[12]|[kPa]|[mm]|[s]|[°C]|$5|$10|$1|100%|50%|<= 12|< 5 V|>= 4 bar|[nota 3]|[0, 10]|[DOC_A1]|[Base]|#12|#3|@ 50 Hz|?|[a]|[b]|{0}|[min]".split("|")
CODES = "[REQ-%s-%d]¦[%s-%d]¦[%s_%d]".split("¦")
PARTS = "AAA BCD EFG XYZ MNO".split()

# Weak labels of a span, by its notation, by words of instruction, and by what stands for codes, sets and references.
PLACEHOLDER = r"\{\{|\{%|<<|\[\[|%\(|@@|##|\$\{|\?{2,}|_{4,}|^X{3,}$|(?i:\b(?:inserire|inserisci|insert|todo|fixme|completare|definire|sostituire|replace|placeholder|segnaposto|fill|tbd|here|einfügen|insérer|insertar)\b)"
REFERENCE = r"^[\[{(][A-Z]{2,}(?:[-_][A-Z]+)*[-_]\d+[\])}]$|^\[\s*[Pp]agina\s+\d+\s*\]$|^\{[^{}]*,[^{}]*\}$|^\[[\d.,;\s-]+\]$|^\[[a-zA-Z°%/]{1,3}\]$|^\[(?:nota|note|fig|tab|rif|ref)\.? ?\d+\]$"

TAGS = r"</?(?:html|head|title|body|h[1-6]|p|div|span|noscript|script|br|b|i|a|center|hr|table|tr|td|ul|li)\b[^>]*>"

# Seed texts of the synthesis, unwanted and sound.
BAD_SEEDS = """
404 Not Found
403 Forbidden. Torna alla pagina iniziale.
HTTP 503: servizio non disponibile - nginx
Errore del server interno. Contattare l'amministratore.
Errore AI: timed out
[Errore AI: connection reset by peer]
Traceback (most recent call last): risposta non valida dal servizio
Please enable JavaScript to view this page. Then reload the page.
JavaScript is disabled in your browser. Browser non supportato.
This viewer works only with scripts turned on. Accept cookies to continue.
Il browser non consente gli script: attivarli e ricaricare. Caricamento in corso...
Per visualizzare il documento è necessario attivare JavaScript.
Bitte aktivieren Sie JavaScript, um fortzufahren.
Lorem ipsum dolor sit amet consectetur adipiscing elit.
Ipsum nulla tempor magna ipsum labore nulla amet aliqua labore ipsum elit nulla tempor veniam.
Testo segnaposto. testo segnaposto. testo segnaposto.
Bla bla bla bla bla bla bla.
Prova prova prova prova prova prova prova.
Asdf qwerty asdf. asdf qwerty asdf.
Qui va il testo. qui va il testo.
Xxx xxx xxx xxx xxx xxx.
Testo provvisorio da sostituire.
Impossibile raggiungere il sito - Please try again in a few minutes.
Sessione scaduta - Il server non risponde.
Too many requests
Access denied. You do not have permission to view this document.
Errore 502: impossibile completare la richiesta.
Errore 400: impossibile elaborare i dati.
Die Seite konnte nicht geladen werden. Fehler 500
Leider wurde die Datei nicht gefunden. Fehler 404
Fehler 503: der Dienst ist nicht erreichbar.
The service cannot be reached. HTTP 502
The server cannot be contacted. HTTP 504
<html><head><title>502 Bad Gateway</title></head><body><h1>nginx</h1></body></html>
"""
GOOD_SEEDS = """
Se manca il consenso, sul display appare un messaggio di errore e l'accesso alle pagine di manutenzione è negato.
Con il codice 404 la diagnostica segnala che manca un segnale, con il 500 che un azionamento è fermo.
All'avvio uno script cancella dal display il testo di prova.
The unit shows an error message and denies access to the service menu when the key is missing.
Mi dispiace, ma non posso riassumere questo contenuto senza altri dettagli.
I cannot summarise this content and suggest asking a qualified engineer.
Come modello linguistico, non sono in grado di confrontare le configurazioni richieste.
Non ho la possibilità di analizzare il testo fornito perché riguarda la sicurezza del veicolo.
Purtroppo devo rifiutare la richiesta senza altri dettagli.
Sintesi:
Ecco la sintesi richiesta.
n.d.
-
La funzione apre il contattore e registra l'evento in memoria.
In sintesi, la funzione definisce come la rampa mobile attende il riscontro.
Se la rete di veicolo non risponde, il gruppo clima chiede la frenatura di servizio.
La valvola di isolamento mantiene la richiesta per 9 cicli.
The section describes how the battery charger refuses commands.
Der Abschnitt beschreibt, wie das Ladegerät die Anforderung hält.
La función abre el contactor y guarda el código.
La fonction bloque la traction et mémorise le code.
La porta si apre.
Il freno resta chiuso fino al consenso.
Apre la valvola.
Gli stati sono quattro.
Stato: chiuso.
Nessuna differenza tra le configurazioni.
La logica è la stessa in tutte le configurazioni.
Il tempo di attesa vale cinque secondi.
The door opens.
The brake stays closed.
No difference between the configurations.
Die Tür öffnet.
Der Zustand bleibt gleich.
La porte s'ouvre.
La puerta se abre.
Il requisito [REQ-ABC-12] è obbligatorio, il valore <= 2 no.
"""

_WEAK = re.compile(f"{STATUS_PATTERN}|{PHRASES}|{FILLER}", re.IGNORECASE | re.MULTILINE)
# Every alternative ends at the next mark of its kind, so a text is read in one pass. Bare signs that also compare or
# count ("<", "@", "#", "__") hold more than a line or 60 characters only where both signs touch what is inside.
_SPAN = re.compile(
    r"\{\{[^{}]*\}\}|\{%(?:[^%{]|%(?!\}))*+%\}|\$?\{[^{}]*\}|<<[^<>]+>>|</?[A-Za-z_][^<>\n]{0,60}>|</?[A-Za-z_][^<>]*[^<>\s]>|‹[^‹›]+›|\[\[[^\[\]]+\]\]|\[[^\[\]]*\]|%\([^()]+\)[sd]|%[A-Za-z_]+%"
    r"|@@?[\w ]{1,40}@@?|@@?\w[\w\s]*\w@@?|##?[A-Za-z_][\w ]{0,40}##?|##?[A-Za-z_][\w\s]*\w##?|__[A-Za-z][\w ]{0,40}?__|__[A-Za-z](?:[^\W_]|\s|_(?!_))*+__|\$[A-Za-z_]\w*\$?|\bX{3,}\b|\?{2,}|_{4,}|\b(?:TODO|FIXME|TBD)\b|(?<!\w)%[sd]\b"
)
_PLACEHOLDER, _REFERENCE = re.compile(PLACEHOLDER), re.compile(REFERENCE)
_WORDY = re.compile(r"[^\W_]{3}")
_TAG = re.compile(TAGS, re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+| - ")


def spans(text: str) -> list[str]:
    """Strings that look like markup of some notation; HTML's own tags aren't among them."""
    return [x for x in _SPAN.findall(text) if not _TAG.fullmatch(x)]


def _shape(span: str) -> str:
    return re.sub(r"\d", "0", span)


def _span_dense(items: list[str]) -> np.ndarray:
    out = np.zeros((len(items), 5))
    for i, x in enumerate(items):
        inner = re.sub(r"^\W+|\W+$", "", x)
        out[i] = (any(c.isdigit() for c in x), "," in x, bool(re.fullmatch(r"[A-Za-z_]+(?: [a-z]+)*", inner)), len(x) > 20, not inner)
    return out


def _body_dense(items: list[str]) -> np.ndarray:
    """Length and title features."""
    out = np.zeros((len(items), 8))
    for i, x in enumerate(items):
        words = x.lower().split()
        first = x.strip().split("\n", 1)[0]
        distinct = len(set(words)) / len(words) if words else 1
        out[i] = (
            np.log1p(len(words)) / 3, len(words) < 12, len(words) < 25, distinct < 0.5 and 3 < len(words) < 60,
            len(first) < 60 and not first.rstrip().endswith("."), "<title" in x.lower(), bool(re.match(r"\W*\d{3}\b", first)), first.isupper(),
        )
    return out


def weak_label(body: str) -> int | None:
    """1 or 0 by the patterns, None where they leave it open."""
    parts = [s for s in _SENTENCE.split(body.strip()) if s.strip()]
    if not parts:
        return None
    words = body.lower().split()
    share = sum(bool(_WEAK.search(s)) for s in parts) / len(parts)
    if share >= 0.5 or (6 <= len(words) <= 60 and len(set(words)) / len(words) <= 0.4):
        return 1
    return 0 if share <= 0.34 else None


def weak_span_label(span: str) -> int | None:
    """1 or 0 by the patterns, None where they leave it open."""
    if _REFERENCE.search(span) or is_status(span):
        return 0
    return 1 if _PLACEHOLDER.search(span) else None


def _rows(bodies: list[str]):
    return word_rows([b.lower() for b in bodies], _body_dense(bodies))


def _span_rows(items: list[str]):
    return char_rows([_shape(x) for x in items], _span_dense(items))


class Residue:
    """The trained pair of classifiers."""

    def __init__(self, body: Linear, span: Linear):
        self.body, self.span = body, span

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Per text the greater of the synthesis' score and that of its worst span."""
        out = np.zeros(len(texts))
        where, bodies, owners, found = [], [], [], []
        for i, t in enumerate(texts):
            if not t or is_status(t):
                continue
            body, _ = split_cell(t)
            if _WORDY.search(body):
                where.append(i)
                bodies.append(body)
            for x in spans(t):
                owners.append(i)
                found.append(x)
        if bodies:
            out[where] = self.body.score(_rows(bodies))
            out[[i for i, b in zip(where, bodies, strict=True) if is_refusal(b)]] = 0.0  # the exact check
        if found:
            kinds, back = np.unique(np.array([_shape(x) for x in found], dtype=object), return_inverse=True)
            np.maximum.at(out, owners, self.span.score(_span_rows(list(kinds)))[back])
        return out


def _held_out(x: list[str], y: np.ndarray, held: np.ndarray, extra: tuple[list[str], list[int]], rows: Callable[[list[str]], Rows]) -> dict:
    """Rows, positives, precision and recall on the weak labels of held-out hosts, of a model trained on the others."""
    if not held.any() or held.all():
        return {}
    part = [t for t, h in zip(x, held, strict=True) if not h] + extra[0]
    trial = fit(rows(part), np.concatenate((y[~held], extra[1])).astype(float))
    said, y = trial.score(rows([t for t, h in zip(x, held, strict=True) if h])) > 0.5, y[held]
    return {"held_out_rows": len(y), "positives": int(y.sum()), "precision": float(y[said].mean()) if said.any() else 1.0, "recall": float(said[y > 0].mean()) if y.any() else 1.0}


def train(df: DataFrame, id_col: str, text_col: str, host_col: str, validate: bool = False) -> Residue:
    """Trains on at most ``SAMPLE`` rows (the least hashes of the id) of at most ``LONGEST`` characters, and the seeds; ``report`` has the validation.

    With ``validate``, a fifth of the hosts, by hash, is held out first; the final models are fitted on all of the sample.
    """
    host = F.crc32(F.upper(F.trim(F.coalesce(F.col(host_col).cast("string"), F.lit("")))))
    picked = bounded_sample(df.where(F.length(text_col) <= LONGEST), id_col, SAMPLE)
    rows = [r for r in picked.select(F.col(text_col).alias("t"), host.alias("host")).collect() if not is_status(r["t"])]
    data = [(split_cell(r["t"])[0], r["host"]) for r in rows]
    data = [(b, h, y) for b, h in data if (y := weak_label(b)) is not None]
    bodies, y, held = [b for b, *_ in data], np.array([y for *_, y in data], np.int64), np.array([h % 5 == 0 for _, h, _ in data], bool)
    seeds = [(s, y) for y, block in ((1, BAD_SEEDS), (0, GOOD_SEEDS)) for s in block.strip().split("\n")] * 3
    seeds = [s for s, _ in seeds], [y for _, y in seeds]
    body = fit(_rows(bodies + seeds[0]), np.concatenate((y, seeds[1])).astype(float))
    # A shape counts once a host, so that a common reference doesn't outweigh all else.
    shapes = sorted(Counter((_shape(x), r["host"]) for r in rows for x in spans(r["t"])).items(), key=lambda e: (-e[1], e[0]))[:SPANS]
    marked = [(x, h, z) for (x, h), _ in shapes if (z := weak_span_label(x)) is not None]
    found, z, apart = [x for x, *_ in marked], np.array([z for *_, z in marked], np.int64), np.array([h % 5 == 0 for _, h, _ in marked], bool)
    bad = [n % f for n in NOTATIONS for f in FIELDS] + EXTRA
    good = (SOUND + [n % (x, k) for n in CODES for x in PARTS for k in (7, 1234)]) * 6
    more = [_shape(x) for x in bad + good], [1] * len(bad) + [0] * len(good)
    span = fit(_span_rows(found + more[0]), np.concatenate((z, more[1])).astype(float))
    if validate:
        body.report, span.report = _held_out(bodies, y, held, seeds, _rows), _held_out(found, z, apart, more, _span_rows)
    return Residue(body, span)


def scored(df: DataFrame, model: Residue, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``score`` of each row whose id isn't null."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null").mapInArrow(run, "id long, score double")
