"""Fixed phrase patterns that several operators use."""

from __future__ import annotations

import re

# Ways to decline a task, by language (it, en, de, fr, es). Matched on lower-cased text.
REFUSALS = r"""
non (?:posso|possiamo|sono in grado di|siamo in grado di|mi è (?:possibile|consentito|permesso)|ho la possibilità di|è possibile per me|ho modo di|riesco a)\b
(?:devo|dobbiamo|sono costretto a|mi vedo costretto a) (?:rifiutare|declinare)
(?:preferisco|preferirei) non
come (?:modello linguistico|assistente|intelligenza artificiale|ia|modello di ia)
(?:rifiuto|declino) (?:la|questa) richiesta
impossibile soddisfare la richiesta
i(?: am|'m|’m)? (?:can ?not|can'?t|can’t|unable to|not able to|not allowed to|not permitted to)\b
i (?:must|have to) (?:decline|refuse)
i (?:won't|won’t|will not|would rather not|prefer not to|do not feel able)\b
i (?:don't|don’t|do not) have the (?:ability|possibility|permission)
as an? (?:ai|language|large language|artificial)\b
ich kann (?:leider |diese[snrm]? |dabei |dazu |das |hier )?[^.]{0,60}nicht\b
ich (?:muss|möchte|darf)\b[^.]{0,60}(?:ablehnen|nicht)\b
(?:leider|bedaure|entschuldigung|tut mir leid)[^.]{0,80}nicht\b
als (?:ki|sprachmodell|künstliche)
ich bin nicht (?:in der lage|befugt|berechtigt)
je ne (?:peux|suis|puis|saurais|souhaite)\b
je (?:dois|préfère)\b[^.]{0,40}(?:refuser|décliner|ne pas)
(?:il ne m'est pas|il m'est impossible|je n'ai pas la possibilité)
en tant (?:que|qu')[^.]{0,12}(?:modèle|ia|assistant)
no (?:puedo|podemos|me es posible|me está permitido|tengo la posibilidad|soy capaz|estoy autorizad[oa]|estoy en condiciones)
(?:debo|tengo que) (?:rechazar|declinar)
prefiero no
como (?:modelo de lenguaje|ia|asistente|inteligencia)
"""

REFUSAL = re.compile(r"(?<!\w)(?:" + "|".join(f"(?:{x})" for x in REFUSALS.strip().split("\n")) + ")")
# Response status and phrases of error messages, which a refusal doesn't have. Matched on lower-cased text.
ERRORS = re.compile(
    r"\bhttp[ /]?\d|\b(?:errore|error|erreur|fehler|status)\s+[45]\d\d\b|^\W*[45]\d\d\b|\([45]\d\d\)|traceback|^\W*(?:errore|error|erreur|fehler)\b[^.]{0,20}:"
    r"|\b(?:pagina|page|seite|página)\b[^.]{0,40}\b(?:non trovata|not found|nicht (?:gefunden|erreichbar)|introuvable|no encontrada|cannot be)\b"
    r"|timed? ?out|connection (?:refused|reset)|bad gateway|internal server|errore del server|too many requests|impossibile raggiungere|il server non risponde|sessione scaduta|session expired|nginx|<html"
)
#: An apology, before which a refusal is likely.
SORRY = re.compile(r"^\W*(?:mi dispiace|mi spiace|purtroppo|chiedo scusa|spiacente|siamo spiacenti|grazie per la richiesta|(?:i'm|i’m|i am|we are) sorry|sorry|unfortunately|i apologi[sz]e|thank you for|es tut mir leid|tut mir leid|leider|entschuldigung|bedaure|désolée?|je suis désolée?|malheureusement|lo siento|lo lamento|desafortunadamente|lamentablemente|por desgracia)")


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def is_refusal(text: str) -> bool:
    """True where a sentence, wherever it stands, begins by declining the task; error messages decline nothing."""
    low = text.strip().lower()
    if not REFUSAL.search(low) or ERRORS.search(low):
        return False
    for sentence in _SENTENCE.split(low):
        m = REFUSAL.search(sentence)
        if m and (m.start() < 60 or SORRY.search(sentence)):
            return True
    return False
