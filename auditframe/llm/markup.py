"""Connected prose of texts in typesetting markup."""

from __future__ import annotations

import re
import unicodedata

_NO_PROSE = "thebibliography|equation|align|alignat|gather|multline|eqnarray|displaymath|math|tabular|tabularx|array|verbatim|lstlisting|tikzpicture|picture|filecontents"
_ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
_LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "i", "j": "j"}

_COMMENT_LINE = re.compile(r"^[ \t]*%[^\n]*(?:\n|\Z)", re.M)
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_OFF = re.compile(r"\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)|\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)", re.S)
_BLOCK = re.compile(r"\\begin\{(%s)\*?\}.*?(?:\\end\{\1\*?\}|\Z)" % _NO_PROSE, re.S)
_MATH = re.compile(r"\$\$.*?\$\$|(?<!\\)\\\[.*?\\\]|(?<!\\)\\\(.*?\\\)|(?<!\\)\$(?:[^$\n]|\n(?![ \t]*\n))*\$", re.S)
_HEADING = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|title|author|date)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_SILENT = re.compile(r"\\(?:cite[a-z]*|[a-zA-Z]*ref|label|input|include|includegraphics|bibliography|bibliographystyle|usepackage|documentclass|url|index|hspace|vspace|pagestyle)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
_EDGE = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\\(?:caption|item)(?![A-Za-z])(?:\[[^\]]*\])?")
_ACCENT = re.compile(r"\\([`'\"^~=.])\s*\{?\\?([A-Za-z])\}?|\\([cvuHkr])(?:\s*\{([A-Za-z])\}|\s+([A-Za-z]))")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[ \t]|(?=\W))?")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?|\\.|[~&]", re.S)
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")

#: Characters that stand for single bytes where UTF-8 was read as a Western one-byte encoding.
_BYTES = {bytes([b]).decode("latin-1"): b for b in range(0x80, 0x100)} | {bytes([b]).decode("cp1252", "ignore"): b for b in range(0x80, 0xA0)}
_BYTES.pop("", None)
_RUN = re.compile("[" + re.escape("".join(_BYTES)) + "]{2,}")


def _reread(match: re.Match) -> str:
    try:
        return bytes(_BYTES[c] for c in match.group()).decode("utf-8")
    except UnicodeDecodeError:
        return match.group()


def _accented(match: re.Match) -> str:
    accent, letter = match.group(1) or match.group(3), match.group(2) or match.group(4) or match.group(5)
    return unicodedata.normalize("NFC", letter + _ACCENTS[accent])


def paragraphs(text: str) -> list[str]:
    """Paragraphs of prose: no comments, switched-off text, bibliography, formulas, tables, headings or commands.

    Text outside the document environment isn't set, so it's no prose; a text without the environment is
    prose throughout. Whatever a cut-off end leaves open goes on to the end.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    start = text.find("\\begin{document}")
    if start >= 0:
        end = text.find("\\end{document}", start)
        text = text[start + 16 : end if end >= 0 else len(text)]
    if "%" in text:
        text = _COMMENT.sub("", _COMMENT_LINE.sub("", text))
    text = _OFF.sub("\n\n", text)
    text = _BLOCK.sub(" ", text)
    text = _MATH.sub(" ", text)
    text = _HEADING.sub("\n\n", text)
    text = _SILENT.sub(" ", text)
    text = _EDGE.sub("\n\n", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", _LETTER.sub(lambda m: _LETTERS[m.group(1)], _ACCENT.sub(_accented, text)))
    text = text.replace("{", "").replace("}", "")
    if not text.isascii():
        text = _RUN.sub(_reread, text)
    return [p for p in _PARAGRAPH.split(text) if p and not p.isspace()]
