"""The running text of a document: without code, headings, tables, badges and addresses of the web."""

from __future__ import annotations

import re

#: Scripts written without blanks between words; each sign counts as a word.
HAN = "぀-ヿ㐀-䶿一-鿿豈-﫿"
#: A word: letters with inner apostrophes, or one sign of those scripts.
WORD = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+(?:['’][^\W\d_{HAN}]+)*")

_FENCE = re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.M | re.S)
_DROP = re.compile(
    r"^[ \t]{0,3}(?:\#{1,6}[ \t][^\n]*|\|[^\n]*|\[?!\[[^\n]*|\*\*[^*\n]+\*\*[ \t]*|[=\-_*]{3,}[ \t]*|<[^>\n]*>[ \t]*|[^\n]*\|[ \t]*-{3,}[^\n]*|//[^\n]*)$"
    r"|^[^\n]+\n(?:={3,}|-{3,})[ \t]*$",
    re.M,
)
_LINE_START = re.compile(r"^[ \t]*(?:>[ \t]?)*(?:[-*+•][ \t]+|\d{1,3}[.)][ \t]+)?", re.M)
_INLINE = re.compile(r"`[^`\n]*`|\b(?:https?|ftp|mailto|ssh|git):\S+|\bwww\.\S+|[\w.+-]+@[\w.-]+|<[^<>\n]{1,200}>")
#: Addresses of mail whose signs are spelled out.
_SPELLED = re.compile(r"[\w.+-]+\s?(?:[(\[{<]\s?at\s?[)\]}>]|\bat\b)\s?[\w-]+(?:(?:\.|\s?(?:[(\[{<]\s?dot\s?[)\]}>]|\bdot\b)\s?)[\w-]+)+", re.I)
#: What tells such an address from plain words, as in "look at this dot".
_SIGNS = re.compile(r"[)\]}>]|AT|^\S*[\d._+-]\S* .* dot ")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
#: Ends of sentences. Abbreviations with inner dots and numbers keep together.
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=\S)|(?<=[。！？])[”’」』）]*\s*|\n+|\s+[|•·/]\s+")


def sentences(text: str) -> list[str]:
    """Sentences and phrases of the prose, in order. No text gives none."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    text = _DROP.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "@" in text or ":" in text or "`" in text or "<" in text or "www." in text:
        text = _INLINE.sub(" ", text)
    if "dot" in text or "DOT" in text or "at)" in text or "at]" in text:
        text = _SPELLED.sub(lambda m: " " if _SIGNS.search(m.group()) else m.group(), text)
    text = _LINE_START.sub("", text)
    return [s for s in (x.strip() for x in _END.split(text)) if s]
