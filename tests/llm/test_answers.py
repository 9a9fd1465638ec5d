"""Defects of answers."""

import pytest
from pyspark.sql import functions as F

from sparkcurate.llm import answers as A
from sparkcurate.llm import endings

Q = "Which files of the project read the settings before the cache is warm, and why?"


@pytest.mark.parametrize("text", [None, "", " \t", "​", "\xa0\n", "-", "—", "...", "N/A", "n/a", "null", "```\n```", "```python\n\n```", "None", "<empty>", "N.A.", "(no text)", "[silence]", "[response removed]", "TBD."])
def test_empty(text):
    assert A.is_empty(text)


@pytest.mark.parametrize("text", ["No.", "Yes.", "None of them.", "0", "`x`", "nothing else may read it", "lib/a.py:3", "(yes)", "[1, 2]", "No text is left there.", "Missing import."])
def test_not_empty(text):
    assert not A.is_empty(text)


@pytest.mark.parametrize("text", ["I cannot help with that request.", "i’m sorry, but i can’t assist with changes to X.", "No comment on `x`, I'm afraid. Please ask someone else.", "Sorry, I won't look into it, since I have no permission for it.", "My apologies. Nothing I am allowed to do would touch it.", "I'd rather not discuss it. Consider asking the owner."])
def test_refusal(text):
    assert A.is_refusal(text)


OTHER_REFUSALS = [
    "I am not going to help with that.", "This request conflicts with my policies.", "I must abstain from answering.", "We are not permitted to share this.", "That is beyond what I can do here.", "I'm afraid I won't be able to answer this one.", "Answering would violate our usage guidelines.",
    "I have to refuse. Please contact the owner of the file.", "It would not be appropriate for me to comment.", "I don't feel comfortable discussing it, so I will not answer.", "No puedo ayudar con eso.", "Lo siento, pero no me es posible responder.", "Je ne peux pas vous aider avec cela.", "Je refuse de répondre.",
    "Das kann ich leider nicht beantworten.", "Dabei darf ich Ihnen nicht helfen.", "Non posso aiutarti con questo.", "Não posso ajudar com isso.", "Daar kan ik je niet mee helpen. Daar mag ik niet op ingaan.", "Eso va contra mis normas.",
]
NO_REFUSALS = [
    "The rules forbid such imports. Move the call into the loader.", "It is not going to help if the cache is cold.", "You cannot answer the prompt twice, as the queue is closed.", "The test does not comply with the schema, because a field is missing.", "No puedes abrir el archivo dos veces, porque el cargador lo cierra.",
    "Die Warteschlange kann nicht geladen werden, weil der Dienst fehlt.", "Je suis sûr que le lecteur ne charge pas le fichier.", "This is beyond the limit of 40 rows.", "We do not support three of the flags. The parser drops them. The loader warns. Then it goes on.",
]


@pytest.mark.parametrize("text", OTHER_REFUSALS)
def test_other_wordings(text):
    assert A.is_refusal(text)


@pytest.mark.parametrize("text", NO_REFUSALS)
def test_negations_that_decline_nothing(text):
    assert not A.is_refusal(text)


def test_long_refusals():
    assert A.is_refusal("I am sorry, but I cannot help with that request. " + "Please contact the owner of the file, who will understand what you need. " * 8)


@pytest.mark.parametrize("text", ["I can't find any other caller of `x`, which is good news. The file reads it twice.", "Sorry for the confusion earlier. The file is right. It reads twice. It ends.", "I am unable to reproduce the error, but the cause is visible. The file reads it twice."])
def test_no_refusal(text):
    assert not A.is_refusal(text)


@pytest.mark.parametrize("text", [Q, Q.upper(), f'"{Q}"', f"You asked: {Q}", f"> {Q}", f"{Q}\n\n{Q}", Q.replace("warm", "wram"), Q.rstrip("?").replace(",", "")])
def test_copy(text):
    assert A.is_copy(Q, text)


def test_no_copy():
    assert not A.is_copy(Q, f"> {Q}\n\nOnly the loader does, because it opens them at import time and keeps a handle.")
    assert not A.is_copy(None, Q) and not A.is_copy("", "Yes.")


def conversations(spark):
    german = "Bitte erkläre mir, warum die Warteschlange nach dem Neustart wieder leer ist und nicht gefüllt wird."
    french = "Le plus simple serait de remplacer le lecteur et de recharger le répertoire avant la fin de la journée."
    rows = []
    for k in range(30):
        rows += [(f"s{k}", 0, "user", f"{Q} Number {k}."), (f"s{k}", 1, "assistant", f"The loader reads them when it starts, because the cache asks for number {k} first. Nothing else does.")]
    rows += [("g", 0, "USER", german), ("g", 1, "assistant", french), ("g", 2, "user", german), ("g", 3, "assistant", "Die Warteschlange ist leer, weil der Dienst nach dem Neustart nicht alles wieder lädt.")]
    rows += [("e", 0, "user", Q), ("e", 1, " Assistant", None), ("e", 2, "user", Q), ("e", 3, "assistant", "I cannot help with that request."), ("e", 4, "user", Q), ("e", 5, "assistant", Q)]
    rows += [("t", 5000, "user", Q), ("t", 9000, "assistant", "The loader reads the files when it starts and then it keeps the han"), ("t", 9001, "assistant", ""), (None, 1, "user", Q), ("n", None, "assistant", "")]
    rows += rows[-4:]
    return spark.createDataFrame(rows, "session_id string, seq bigint, role string, content string"), german, french


def test_defects_and_blocks(spark):
    df, german, french = conversations(spark)
    docs = [(i, t * 2, lang) for i, (t, lang) in enumerate([(german, "de"), (french, "FR"), (Q + " The loader reads them when it starts and nothing else does.", "en")] * 4)] + [(99, "x", None), (98, None, "en"), (97, "x", "unknown")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    said = df.filter("role = 'assistant'").select(F.col("content").alias("text"))
    want = {("g", 1, "language"), ("e", 1, "empty"), ("e", 3, "refusal"), ("e", 5, "copy"), ("t", 9000, "truncated")}
    for block in (1024, 2, 100_000):
        got = A.defects(A.turns_of_rows(df, "chat", block=block), said, documents)
        assert {(r.rec_id, r.pos, r.defect) for r in got.collect()} == want, block


def test_a_conversation_that_changes_its_language(spark):
    df, german, french = conversations(spark)
    english = f"{Q} The loader reads them when it starts and nothing else does."
    rows = [("x", 0, "user", german), ("x", 1, "assistant", "Die Warteschlange ist leer, weil der Dienst nach dem Neustart nicht alles wieder lädt."), ("x", 2, "user", english), ("x", 3, "assistant", "The loader asks for the number first, because the cache is warm before it starts."), ("x", 4, "user", "ok?"), ("x", 5, "assistant", french)]
    df = df.unionByName(spark.createDataFrame(rows, df.schema))
    docs = [(i, t * 2, lang) for i, (t, lang) in enumerate([(german, "de"), (french, "fr"), (english, "en")] * 4)]
    got = A.defects(A.turns_of_rows(df, "chat"), df.filter("role = 'assistant'").select(F.col("content").alias("text")), spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert [(r.pos, r.defect) for r in got.filter("rec_id = 'x'").collect()] == [(5, "language")]


def test_ends_are_learned(spark):
    """A closing word that many texts end with is an end, the same kind of characters elsewhere is none; whatever stands beside it in a batch."""
    said = [f"The loader number {k} reads the file. It stops after {k} rows. {'Many thanks' if k % 4 == 0 else 'Good.'}" for k in range(400)]
    model = endings.end_model(spark.createDataFrame([(t,) for t in said + [None, "", "x"]], "text string"))
    sound, cut, again = endings.end_scores(["It works. Many thanks", "It works. Many loader", "It works. Many thanks"], model)
    assert sound > 0 > cut and sound == again
    assert endings.end_scores(["ok."], model)[0] == endings.end_scores(["a" * 90, "ok."], model)[1]
    empty = endings.end_model(spark.createDataFrame([], "text string"))
    assert endings.end_scores([None, "abc."], empty).shape == (2,)


def test_arrays(spark):
    rows = [(1, [("user", Q), ("Assistant ", ""), ("assistant", "")]), (2, None), (3, []), (4, [("system", "s"), ("assistant", "")]), (1, [("user", Q), ("Assistant ", ""), ("assistant", "")])]
    df = spark.createDataFrame(rows, "id bigint, messages array<struct<role:string,content:string>>")
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    got = A.defects(A.turns_of_arrays(df, "t", "id"), spark.createDataFrame([], "text string"), none)
    assert [tuple(r) for r in got.collect()] == [("t", "1", 1, "empty")]
