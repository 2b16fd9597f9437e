"""Languages: prose of markup, labels, and accuracy on held-out sentences."""

import random

import pytest

from auditframe.llm import languages as L
from auditframe.llm.markup import paragraphs

DOCS = "doc_id bigint, text string, lang string, held string"

# small grammars: enough for texts that differ in words and letters
PARTS = {
    "en": ("the model|the field|a proof|this result|each measurement|our method", "shows|becomes|is compared with|depends on|follows from|does not change", "under weak conditions|for all but nine samples|in the limit|as expected|up to a constant|because we repeat it"),
    "de": ("das Modell|das Feld|ein Beweis|dieses Ergebnis|jede Messung|unser Verfahren", "zeigt|wird|wird verglichen mit|hängt ab von|folgt aus|ändert nicht", "unter schwachen Bedingungen|für alle außer neun Proben|im Grenzfall|wie erwartet|bis auf eine Konstante|weil wir es wiederholen"),
    "fr": ("le modèle|le champ|une preuve|ce résultat|chaque mesure|notre méthode", "montre|devient|est comparé avec|dépend de|suit de|ne change pas", "sous des conditions faibles|pour tous les échantillons sauf neuf|dans la limite|comme prévu|à une constante près|parce que nous le répétons"),
    "es": ("el modelo|el campo|una prueba|este resultado|cada medición|nuestro método", "muestra|se vuelve|se compara con|depende de|sigue de|no cambia", "bajo condiciones débiles|para todas las muestras salvo nueve|en el límite|como se esperaba|salvo una constante|porque lo repetimos"),
    "pt": ("o modelo|o campo|uma prova|este resultado|cada medição|o nosso método", "mostra|torna-se|é comparado com|depende de|segue de|não muda", "sob condições fracas|para todas as amostras exceto nove|no limite|como esperado|a menos de uma constante|porque o repetimos"),
    "ru": ("модель|поле|доказательство|этот результат|каждое измерение|наш метод", "показывает|становится|сравнивается с|зависит от|следует из|не меняет", "при слабых условиях|для всех образцов кроме девяти|в пределе|как и ожидалось|с точностью до постоянной|потому что мы повторяем это"),
}


def prose(make, lang, sentences):
    subject, verb, rest = (p.split("|") for p in PARTS[lang])
    return " ".join(f"{make.choice(subject)} {make.choice(verb)} {make.choice(subject)} {make.choice(rest)}.".capitalize() for _ in range(sentences))


@pytest.fixture(scope="module")
def fitted(spark):
    make = random.Random(8)
    rows = [(i, prose(make, lang, 8), lang, "") for i, lang in enumerate(list(PARTS) * 40)]
    return L.fit_prototypes(spark.createDataFrame(rows, DOCS), sample=30)


def test_prose_of_markup():
    text = "preamble \\begin{document}\n% all of this line\nA \\emph{b} c\\'e \\c{c}a gro\\ss e $x+1$ d \\cite{k}. %rest\n\\iffalse off \\fi\n\n\\section{Head}\\begin{comment}\nno\n\\end{comment}\nNext \\(y\n z\\) one \\begin{equation} q \\end{equation} two\\footnote{note}.\n\n\\begin{thebibliography}{1} \\bibitem{k} Ref \\end{thebibliography}\\end{document} after"
    assert [" ".join(p.split()) for p in paragraphs(text)] == ["A b cé ça große d .", "Next one two note."]
    assert paragraphs("") == [] and paragraphs("dafÃ¼r groÃ\x9f") == ["dafür groß"]
    assert [p.split() for p in paragraphs("a\r\n\r\nb \\begin{thebibliography} cut off")] == [["a"], ["b"]]


def test_held_out_accuracy(fitted):
    make, scores = random.Random(99), L.WordScores(fitted)
    right = 0
    for _ in range(600):
        lang = make.choice(list(PARTS))
        ((*_, k, _),) = list(L.passages(prose(make, lang, 1), scores, 1e9))
        right += fitted.languages[k] == lang
    assert right >= 590


def test_table_is_the_product(fitted):
    words = "dieses ergebnis zeigt das feld".split()
    import numpy as np

    codes = np.array([c for w in words for c in L.trigrams(w)])
    vector = L.bind(codes).astype(np.float64).sum(0)
    scores = L.WordScores(fitted)
    assert np.allclose(scores.of(words).sum(0), vector @ fitted.vectors.T.astype(np.float64), rtol=1e-3, atol=1e-2)
    assert np.isclose(scores.cosine(words, 1), vector @ fitted.vectors[1] / np.linalg.norm(vector), rtol=0.1)
    unseen = L.WordScores(fitted).of(["zzqqxx"])
    assert np.allclose(unseen[0], L.bind(np.array(L.trigrams("zzqqxx"))).sum(0) @ fitted.vectors.T, atol=1e-2)


def test_documents(spark, fitted):
    make = random.Random(3)
    en, de, ru = (prose(make, k, 6) for k in ("en", "de", "ru"))
    rows = [
        (1, en, "en", ""), (2, en, " EN-us ", ""), (3, en, "English", ""), (4, en, "de", ""), (5, en, None, ""), (6, en, "und", ""), (7, en + "\n\n" + de, "en", ""), (8, en + " " + ru, "ru", ""),
        (9, en + " " + prose(make, "de", 1), "en", ""), (10, "% " + de + "\n" + en, "en", ""), (11, None, "en", ""), (12, "", "xx", ""), (13, "short text", "de", ""), (14, en, "en+ru", ""), (15, (de + "\n\n") * 500, "français", ""), (16, en, "?", ""), (16, en, "?", ""),
    ]
    judged = L.document_languages(spark.createDataFrame(rows, DOCS), fitted)
    assert judged.count() == len(rows)
    found = sorted(set(map(tuple, L.mislabelled(judged).collect())))
    assert found == [(4, "en"), (5, "en"), (6, "en"), (7, "de"), (7, "en"), (8, "en"), (8, "ru"), (14, "en"), (15, "de"), (16, "en")]
    inside = L.find_passages(spark.createDataFrame(rows, DOCS), fitted, every=False).filter("doc_id = 8").collect()
    assert [r["lang"] for r in inside] == ["en", "ru"] and all(0.2 < r["confidence"] <= 1 for r in inside)


def test_no_labels(spark):
    rows = [(1, "some text", None, ""), (2, "more", "klingon", "")]
    assert L.mislabelled(L.document_languages(spark.createDataFrame(rows, DOCS))).count() == 0
    assert L.document_languages(spark.createDataFrame([], DOCS)).count() == 0
