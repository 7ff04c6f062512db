"""Line-first quality rules.

Every line is judged on its own: punctuation, shouting, navigation, stutter,
boilerplate, repeated line.  Failing lines are removed; a document that loses
too large a share of its words goes.
"""

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SYMBOLS = b"#*$%&|<>"
#: Fixed phrases of licence, legal and site furniture lines, matched in lower case.
BOILERPLATE = re.compile(
    rb"licensed under|all rights reserved|copyright (\(c\)|\xc2\xa9|\d{4})|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies"
    rb"|subscribe to our|sign up for our|click here|enable javascript|skip to (main )?content|back to top|spdx-license-identifier|without warranty of any kind"
    rb"|(we|site|website|page) uses? cookies|uses? cookies to (improve|enhance|give|ensure)|powered by (wordpress|drupal|joomla|blogger|shopify)|leave a (comment|reply)|share (this )?on (facebook|twitter|linkedin)"
    rb"|utilis(e|ons) des cookies|(verwende[nt]|nutz(t|en)) cookies|(usamos|utiliza(mos)?) cookies"
    rb"|tous droits r\xc3\xa9serv\xc3\xa9s|mentions l\xc3\xa9gales|politique de confidentialit\xc3\xa9|conditions d'utilisation|cliquez ici|haut de page"
    rb"|alle rechte vorbehalten|datenschutzerkl\xc3\xa4rung|nutzungsbedingungen|hier klicken|zum seitenanfang|cookie-einstellungen"
    rb"|todos los derechos reservados|pol\xc3\xadtica de (privacidad|cookies)|aviso legal|t\xc3\xa9rminos de uso|haga clic aqu\xc3\xad"
)
#: Signs between the items of a menu.
SEPARATOR = re.compile(rb"\s+(?:[/|>]|->|\xc2\xb7|\xc2\xbb|\xe2\x80\xa2|\xe2\x80\xba|\xe2\x86\x92)\s+")
#: Signs that only stand between the steps of a path through a site, where two items are enough.
BREADCRUMB = re.compile(rb"\s+(?:\xc2\xbb|\xe2\x80\xba)\s+")
#: One sign over and over.
RULER = re.compile(rb"([-=_~.+*#])\1{2,}")
LINK_WORDS = frozenset(
    b"home about contact login logout register sitemap products services blog news faq help search cart checkout account profile privacy terms"
    b" careers support docs api next previous prev menu back share tweet subscribe download downloads forum gallery archive archives categories"
    b" accueil produits actualit\xc3\xa9s connexion panier recherche aide startseite produkte kontakt impressum datenschutz anmelden warenkorb suche hilfe"
    b" inicio productos contacto noticias carrito buscar ayuda".split()
)


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are of a line's words or bytes, lost_share of a document's words."""

    symbol_share: float = 0.08
    shout_words: int = 5
    shout_share: float = 0.8
    mark_share: float = 0.5
    bar_share: float = 0.25
    menu_items: int = 3
    item_words: int = 3
    menu_words: int = 12
    link_share: float = 0.6
    stutter_words: int = 6
    stutter_share: float = 0.5
    repeat_words: int = 5
    phrase_share: float = 0.06
    lost_share: float = 0.4
    min_words: int = 50
    repeat_share: float = 0.5


def base_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text's UTF-8 bytes."""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if found[window] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def is_menu(line: bytes, words: list[bytes], rules: Rules) -> bool:
    """Short items between separators, or a run of link words, without a sentence end."""
    if words[-1][-1:] in b".!?:;,":
        return False
    items = SEPARATOR.split(line.strip())
    if len(items) == 2 and BREADCRUMB.search(line):
        return all(len(item.split()) <= rules.item_words for item in items)
    if len(items) >= rules.menu_items:
        sizes = [len(item.split()) for item in items]
        # figures between signs are tables or sums
        return max(sizes) <= rules.item_words and not any(c in b"0123456789=" for item in items for c in item)
    if rules.menu_items <= len(words) <= rules.menu_words:
        links = sum(w.lower() in LINK_WORDS for w in words)
        return links >= rules.link_share * len(words)
    return False


def menu_lines(lines: list[list[bytes]], rules: Rules) -> set[int]:
    """Numbers of short lines that are items of a menu: neighbours (blank lines apart) most of which are link words."""
    found: set[int] = set()
    run: list[int] = []
    for i, words in [*enumerate(lines), (len(lines), [b"."])]:
        if not words:
            continue
        if len(words) <= rules.item_words and words[-1][-1:] not in b".!?:;,":
            run.append(i)
            continue
        if len(run) >= rules.menu_items and sum(any(w.lower() in LINK_WORDS for w in lines[j]) for j in run) >= rules.link_share * len(run):
            found.update(run)
        run = []
    return found


def line_fault(line: bytes, words: list[bytes], rules: Rules) -> str | None:
    """The first rule that a line breaks, or None."""
    n = len(words)
    if n <= rules.menu_words * rules.menu_items and is_menu(line, words, rules):
        return "navigation"
    if RULER.fullmatch(b"".join(words)):
        return "punctuation"
    solid = sum(map(len, words))
    if solid - len(b"".join(words).translate(None, SYMBOLS)) > rules.symbol_share * solid:
        bars = sum(w == b"|" for w in words)
        return "navigation" if bars and bars >= rules.bar_share * n else "punctuation"
    if n >= rules.shout_words:
        if sum(w[-1:] in b"!?" for w in words) > rules.mark_share * n:
            return "punctuation"
        if sum(w.isupper() and len(w) > 1 for w in words) > rules.shout_share * n:
            return "shouting"
    if n >= rules.stutter_words and sum(a == b for a, b in zip(words, words[1:], strict=False)) > rules.stutter_share * n:
        return "stutter"
    if sum(len(found[0].split()) for found in BOILERPLATE.finditer(line.lower())) > rules.phrase_share * n:
        return "boilerplate"
    return None


def clean_lines(text: bytes, rules: Rules = Rules()) -> tuple[bytes, int, int]:
    """(text without failing lines, lines removed, words removed); blank lines stay."""
    kept, removed, lost, seen = [], 0, 0, set()
    lines = text.split(b"\n")
    split = [line.split() for line in lines]
    menus = menu_lines(split, rules)
    for i, (line, words) in enumerate(zip(lines, split, strict=True)):
        if words:
            again = len(words) >= rules.repeat_words and line in seen
            seen.add(line)
            if again or i in menus or line_fault(line, words, rules):
                removed, lost = removed + 1, lost + len(words)
                continue
        kept.append(line)
    return (b"\n".join(kept) if removed else text), removed, lost


def judge(text: bytes | None, rules: Rules = Rules()) -> tuple:
    text = text or b""
    n_words, chars, symbols, dup_lines, repeats = base_stats(text)
    failed = n_words < rules.min_words or repeats > rules.repeat_share * n_words
    cleaned, removed, lost = clean_lines(text, rules)
    kept = not failed and lost <= rules.lost_share * n_words
    return n_words, chars, symbols, dup_lines, repeats, failed, kept, removed, lost, cleaned.decode("utf-8", "replace")


_SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lines_removed bigint, n_words_removed bigint, clean_text string"


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All columns of docs with base counts, verdict `kept` and `clean_text` (text without failing lines).

    A map over rows, no shuffle.  A NULL or empty text has no words: it fails and
    its clean_text is empty.  Repeated rows are judged alike, one by one; columns
    of docs that clash with an added name are dropped, NULLs elsewhere are kept.
    """
    added = {part.split()[0] for part in _SCHEMA.split(", ")}
    keep = [c for c in docs.columns if c != "text" and c.lower() not in added]
    return map_texts(docs, lambda text: judge(text, rules), _SCHEMA, keep)


def apply_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Kept documents with failing lines removed, in docs' own columns, whatever their names; n_chars follows the text.

    NULL and empty texts fail; NULLs in other columns stay; repeated rows are
    judged one by one.
    """
    names = {c: f"{i} of document" for i, c in enumerate(docs.columns) if c != "text"}
    judged = quality_rules(docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]), rules).where("kept")
    new = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return judged.select(*[new.get(c, F.col(f"`{names.get(c, c)}`")).alias(c) for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select("doc_id", "text")).drop("clean_text")
