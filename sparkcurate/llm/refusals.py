"""Refusals by their grammar, in seven languages.

A sentence declines if its speaker may not, cannot or will not (a form of being unable or unwilling, with its negation) do what answering consists in (help,
answer, discuss, share ...), if the speaker declines outright, or if their own rules speak against it.  The classes of words are combined freely, so
wordings need not be listed.  An answer is a refusal if it declines in one of its first two sentences and most of the others are courtesies; what holds
code or a call is none.  Accents and the form of apostrophes do not count.
"""

from __future__ import annotations

import re
import unicodedata

from sparkcurate.llm.bags import WORD

#: Up to so many characters of one clause may stand between the parts of a pattern.
GAP = r"[^.!?;\n]{0,40}?"

HELP = r"(?:(?:help|assist|answer|discuss|shar|provid|compl|comment|support|offer|continu|talk|speak|fulfil+|respond|repl|engag|disclos|reveal|participat|advis|proceed|oblig|touch|giv|tell|say)(?:e|y|ing|ying)?|do (?:this|that|it|so)|go into|get into|look into|work on|take (?:this|that|part)|carry (?:this|that|it) out|complete (?:this|that)|process (?:this|that)|be of (?:help|assistance))\b"
UNABLE = r"(?:can ?not|can't|could not|couldn't|won't|will not|shall not|shan't|must not|mustn't|may not|(?:am|are|'m|'re) (?:\w+ )?not (?:\w+ )?(?:able|allowed|permitted|going|willing|prepared|authori[sz]ed|comfortable|in a position|supposed)|(?:am|are|'m|'re) (?:\w+ )?unable|(?:do not|don't) (?:feel (?:able|comfortable)|have permission|wish|want)|would not (?:feel|like|want))"
RULES = r"(?:instructions|guidelines|rules|polic(?:y|ies)|restrictions|principles|terms|limits|configuration)"
AGAINST = r"(?:conflict|violat|against|forbid|prohibit|prevent|breach|contraven|(?:not|n't) (?:allow|permit|let)|bars? me|stop me|rules? (?:this|that|it) out)"

#: As parts of an expression in which blanks do not count.
HELP, UNABLE, RULES, AGAINST = (x.replace(" ", r"\ ") for x in (HELP, UNABLE, RULES, AGAINST))

ENGLISH = rf"""
    \b(?:i|we|i'm|we're)\b\ ?(?:\w+\ ){{0,3}}?{UNABLE}\b{GAP}\b{HELP}
  | \b(?:i|we)\b{GAP}\b(?:must|have\ to|need\ to|will|would\ rather|choose\ to|am\ going\ to|'ll)\b{GAP}\b(?:decline|refuse|abstain|refrain|pass\ on)\b
  | \b(?:i|we)\ (?:\w+\ )?(?:decline|refuse|abstain|refrain)\b | \bi(?:'d|\ would)\ (?:rather|prefer)\ (?:to\ )?not\b
  | \b(?:my|our)\ (?:\w+\ ){{0,2}}{RULES}\b{GAP}{AGAINST} | {AGAINST}\w*{GAP}\b(?:my|our)\ (?:\w+\ ){{0,2}}{RULES}\b
  | \b(?:outside|beyond|not\ within|out\ of)\ (?:of\ )?(?:my|our|what\ (?:i|we))\ | \b(?:outside|beyond|out\ of)\ (?:of\ )?the\ scope\ of\ what\ (?:i|we)\b
  | \bno\ comment\b | \bnot\ (?:something|anything|a\ (?:topic|subject|request))\ (?:that\ )?(?:i|we)\b | \bnothing\ (?:i|we)\ (?:am|are|can|may)\b
  | \bnot\ be\ (?:right|appropriate|proper|ethical|responsible)\ (?:for\ (?:me|us)\ )?to\b | \b(?:i|we)\ have\ no\ (?:permission|authori[sz]ation)\b
  | \b(?:asked|told|instructed)\ (?:not\ )?to\ (?:leave|avoid|decline|refuse|stay\ away)\b
  | \b(?:talk|speak)\ about\ something\ else\b | \bchange\ the\ (?:subject|topic)\b
"""
GERMAN = rf"""
    \b(?:kann|darf|werde|mochte|will|konnen|durfen|werden|wollen)\b{GAP}\b(?:nicht|keine)\b{GAP}\b(?:\w*helf\w*|unterstutz\w*|\w*antwort\w*|auskunft|besprech\w*|diskutier\w*|nachkomm\w*|\w*machen|tun|leisten)\b
  | \bdas\ (?:kann|darf|mochte|werde)\ ich\ (?:\w+\ )?nicht\b | \b(?:muss|mochte)\b{GAP}\b(?:ablehnen|verweigern)\b | \blehne\b{GAP}\bab\b
  | \b(?:gegen|verstosst|widerspricht|verbieten|untersagen)\b{GAP}\b(?:meine|meinen|unsere|unseren)\ (?:\w+\ )?(?:richtlinien|regeln|vorgaben|anweisungen)\b
"""
SPANISH = rf"""
    \bno\ (?:\w+\ )?(?:puedo|podemos|voy\ a|vamos\ a|es\ posible|estoy\ autorizad[oa]|tengo\ permiso|debo|quiero|deseo)\b{GAP}\b(?:ayud\w+|respond\w+|asist\w+|contest\w+|proporcion\w+|compart\w+|habl\w+|discut\w+|hacer(?:lo)?|coment\w+|cumpl\w+|atend\w+|ofrec\w+|dar\w*|decir\w*)\b
  | \b(?:debo|tengo\ que|prefiero|obligad[oa]\ a)\b{GAP}\b(?:declin\w+|rechaz\w+|neg\w+me|absten\w+|no)\b | \bcontra\ (?:de\ )?(?:mis|nuestras)\b
"""
FRENCH = rf"""
    \b(?:je|nous)\ (?:ne\ |n')?(?:\w+\ )?(?:peux|pouvons|puis|suis|vais|veux|dois|saurais|souhaite|pourrai)\b{GAP}\bpas\b{GAP}\b(?:aider|repondre|assister|traiter|fournir|partager|discuter|parler|faire|donner|commenter|autoris\w+|en\ mesure|accepter)\b
  | \bje\ (?:refuse|decline|dois\ (?:refuser|decliner)|m'abstiens|prefere\ ne)\b | \bcontraires?\ a\ (?:mes|nos)\b | \bcontre\ (?:mes|nos)\ (?:regles|directives|consignes|principes)\b
"""
ITALIAN = rf"""
    \bnon\ (?:\w+\ )?(?:posso|possiamo|sono\ (?:in\ grado|autorizzat[oa])|e\ possibile|ho\ il\ permesso|intendo|voglio)\b{GAP}\b(?:aiut\w+|rispond\w+|assist\w+|forn\w+|condivid\w+|discut\w+|parl\w+|farlo|comment\w+|dare|dirlo)\b
  | \b(?:devo|preferisco)\b{GAP}\b(?:rifiut\w+|declin\w+|astener\w+|non)\b | \bcontr(?:o|ari[oa]\ all)\w*\ (?:le\ )?(?:mie|nostre)\b
"""
PORTUGUESE = rf"""
    \bnao\ (?:\w+\ )?(?:posso|podemos|vou|estou\ autorizad[oa]|tenho\ permissao|devo|quero|consigo)\b{GAP}\b(?:ajud\w+|respond\w+|assist\w+|fornec\w+|compartilh\w+|partilh\w+|discut\w+|falar|faz\w+|coment\w+|atend\w+|dar|dizer)\b
  | \b(?:devo|tenho\ que|prefiro)\b{GAP}\b(?:recus\w+|declin\w+|abster\w*|nao)\b | \bcontra\ (?:as\ )?(?:minhas|nossas)\b
"""
DUTCH = rf"""
    \b(?:kan|mag|zal|wil|kunnen|mogen)\b{GAP}\bniet\b{GAP}\b(?:help\w*|beantwoord\w*|antwoord\w*|assister\w*|bespreken|ingaan|meewerken|verstrekken|delen|doen)\b
  | \bmoet\b{GAP}\b(?:weigeren|afwijzen)\b | \btegen\ (?:mijn|onze)\ (?:regels|richtlijnen|instructies)\b
"""
DECLINES = re.compile("|".join((ENGLISH, GERMAN, SPANISH, FRENCH, ITALIAN, PORTUGUESE, DUTCH)), re.X)
#: A word of each branch: what has none of them is not looked at further.
HINT = re.compile(r"n't|not|unable|declin|refus|abst|refrain|my |our |outside|beyond|out of|comment|nothing|no permi|no autho|told|asked|instructed|something else|subject|topic|rather|prefer|nicht|keine|muss|mochte|lehne|gegen|verst|wider|no |nao |non |debo|tengo|prefi|obligad|contr|pas |je |devo|tenho|niet|moet|tegen")
#: Courtesies that may go with a refusal, and its reasons.
POLITE = re.compile(r"thank|consider|contact|owner|understand|someone else|administrator|reviewer|rephras|anything else|sorry|apolog|shall i|please|guideline|permission|topic|instruction|request|unfortunately|decline|instead|polic|bitte|leider|danke|tut mir leid|gracias|lo siento|por favor|merci|desole|s'il vous|grazie|mi dispiace|per favore|obrigad|desculp|lamento|dank|helaas|sorry")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def plain(text: str) -> str:
    t = text.replace("’", "'").lower()
    return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t.replace("ß", "ss")) if not unicodedata.combining(c))


def declines(sentence: str) -> bool:
    """Whether a sentence (as ``plain`` gives it) declines."""
    return bool(HINT.search(sentence)) and bool(DECLINES.search(sentence))


def is_refusal(text: str) -> bool:
    if "```" in text or "<tool_call>" in text:
        return False
    parts = [p for p in SENTENCE.split(plain(text.strip())) if WORD.search(p)]
    if not any(declines(p) for p in parts[:2]):
        return False
    # one other sentence, or one in three of a long answer, may be something else
    others = sum(not POLITE.search(p) and not declines(p) for p in parts)
    return others <= max(1, len(parts) // 3)
