import pytest

from matchup_graph.llm import quality
from test_operators import prose

MENUS = ["Home / Products / Contact / Login", "Home · About · Contact", "Home » Docs » API", "Home About Contact Login Register", "home > news > archive", "Home • Our team • Press", "Accueil » Produits", "Startseite Produkte Kontakt Impressum"]


@pytest.mark.parametrize("line", [*MENUS, "-----", "= = =", "Tous droits réservés 2021", "Alle Rechte vorbehalten.", "Todos los derechos reservados", "Home\nAbout us\n\nProducts\nContact"])
def test_menus_and_rulers_go(line):
    text = prose(200, 5)
    assert quality.clean_lines(f"{text}\n{line}\n{text[::-1]}".encode())[0].replace(b"\n\n", b"\n") == f"{text}\n{text[::-1]}".encode()
    if line in MENUS:
        assert quality.line_fault(line.encode(), line.encode().split(), quality.Rules()) == "navigation"


@pytest.mark.parametrize(
    "line",
    ["He went home to search for help", "The United Nations Security Council", "a / b", "x = a / b / c", "1 / 2 / 3", "Please contact support about the account.", "and/or · or so", "Milk\nEggs\nBread", "Chapter One\nThe house", "-- he said --", "She left home, then came back to the old house about which he wrote"],
)
def test_prose_stays(line):
    text = f"{prose(100, 5)}\n{line}".encode()
    assert quality.clean_lines(text)[0] == text


FURNITURE = ["Nous utilisons des cookies", "Diese Website verwendet Cookies", "We use cookies to improve your experience", "Powered by WordPress", "Leave a comment", "Share on Facebook", "Copyright 2021 Acme. All rights reserved. Read our privacy policy and terms of use."]


@pytest.mark.parametrize("line", FURNITURE)
def test_furniture_goes(line):
    assert quality.line_fault(line.encode(), line.encode().split(), quality.Rules()) == "boilerplate"


@pytest.mark.parametrize("phrase", ["privacy policy", "click here", "all rights reserved"])
def test_one_phrase_does_not_take_a_long_line_with_it(phrase):
    words = prose(400, 3).replace("\n", " ").split()
    text = " ".join([*words[:200], *phrase.split(), *words[200:]]).encode()
    kept = quality.judge(text)
    assert kept[6] and kept[7] == 0 and kept[9].encode() == text
