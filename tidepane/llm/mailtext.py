"""Own content of raw mails: decoded text parts without headers, quoted mail, greetings, signatures and disclaimers.

A tolerant reader made for many small messages: it never fails, whatever the
input. Multipart mails may be nested or not closed; parts may be plain, base64
or quoted-printable; line ends may be mixed.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER = re.compile(r"^([A-Za-z][A-Za-z0-9-]*)[ \t]*:[ \t]*(.*)$")
_MBOX = re.compile(r">?From\s")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([\w.:-]+)', re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_QP = re.compile(rb"=([0-9A-Fa-f]{2})")
#: Nested multiparts are followed this deep; a part nested deeper is read as text.
MAX_DEPTH = 20


def _headers(lines: list[str]) -> tuple[dict[str, str], int]:
    """Header fields in lower case (the first of each name), and the index of the first body line."""
    found: dict[str, str] = {}
    name, at = "", 0
    for at, line in enumerate(lines):
        if not line.strip():
            return found, at + 1
        if line[0] in " \t" and name:
            found[name] += " " + line.strip()
            continue
        m = _HEADER.match(line)
        if m:
            key = m[1].lower()
            name = key if key not in found else "\0"
            found[name] = m[2] if name != "\0" else ""
        elif _MBOX.match(line):
            name = ""  # an mbox line, at the start or after a relay's fields
        elif not found:
            return {}, 0  # no headers at all: everything is body
        else:
            return found, at
    return found, len(lines)


def _charset(kind: str) -> str:
    m = _CHARSET.search(kind)
    return m[1] if m else "utf-8"


def _text(data: bytes, charset: str) -> str:
    for c in (charset, "utf-8"):
        try:
            return data.decode(c)
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("latin-1")


def _decoded(body: str, encoding: str, kind: str) -> str:
    encoding = encoding.strip().lower()
    if encoding == "base64":
        raw = _NOT_BASE64.sub("", body)
        raw = raw[: len(raw) - len(raw) % 4] if len(raw) % 4 == 1 else raw + "=" * (-len(raw) % 4)
        try:
            return _text(binascii.a2b_base64(raw), _charset(kind))
        except (binascii.Error, ValueError):
            return body
    if encoding == "quoted-printable":
        joined = re.sub(r"=[ \t]*\n", "", body)
        data = _QP.sub(lambda m: bytes([int(m[1], 16)]), joined.encode("utf-8", "surrogatepass"))
        return _text(data, _charset(kind))
    return body


# Characters that bytes 0x80 to 0x9f become in Windows-1252.
_ONE_BYTE = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_MISREAD = re.compile("[\x80-\xff" + "".join(map(chr, _ONE_BYTE)) + "]{2,}")


def repaired(text: str) -> str:
    """Text in which UTF-8 that was read as a one-byte encoding is put right again, run by run."""

    def again(m: re.Match) -> str:
        try:
            return m[0].translate(_ONE_BYTE).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]

    return text if text.isascii() else _MISREAD.sub(again, text)


def text_parts(message: str) -> list[tuple[str, str]]:
    """Decoded text parts as (``plain`` or ``html``, text), attachments and attached mails left out."""
    lines = message.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[tuple[str, str]] = []
    todo = [(lines, 0)]
    while todo:
        part, depth = todo.pop(0)
        head, at = _headers(part)
        kind = head.get("content-type", "text/plain")
        low = kind.lower()
        if low.startswith("multipart/") and depth < MAX_DEPTH:
            m = _BOUNDARY.search(kind)
            mark = "--" + (m[1] or m[2]) if m else ""
            pieces: list[list[str]] = []
            current: list[str] | None = None
            for line in part[at:]:
                if mark and line.startswith(mark) and line[len(mark) :].strip() in ("", "--"):
                    current = None
                    if not line[len(mark) :].strip():
                        pieces.append(current := [])
                elif current is not None:
                    current.append(line)
            if pieces:
                todo[:0] = [(p, depth + 1) for p in pieces]
                continue
            low = "text/plain"
        if head.get("content-disposition", "").lower().startswith("attachment") or not (low.startswith("text/") or "/" not in low):
            continue
        body = _decoded("\n".join(part[at:]), head.get("content-transfer-encoding", ""), kind)
        out.append(("html" if "html" in low else "plain", body))
    return out


_BREAK = re.compile(r"<\s*(?:br|/?p|/?div|/?li|/?tr|/?h\d|/?ul|/?ol|/?table)\b[^>]*>", re.I)
_QUOTED_MARKUP = re.compile(r"<blockquote\b.*?(?:</blockquote\s*>|\Z)", re.I | re.S)
_LINK = re.compile(r"<a\b[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)[^>]*>(.*?)</a\s*>", re.I | re.S)
_DROP = re.compile(r"<(style|script|head|title)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^<>]+>")
LINK_OPEN, LINK_CLOSE = "\x02", "\x03"


def markup_text(source: str) -> str:
    """Text of markup, also what a reader would not see; link texts stand between two control characters."""
    source = _QUOTED_MARKUP.sub("\n", source)
    source = _DROP.sub(" ", source)
    source = _LINK.sub(lambda m: f" {LINK_OPEN}{_TAG.sub(' ', m[2])}{LINK_CLOSE} ", source)
    if _BREAK.search(source):
        source = _BREAK.sub("\n", source.replace("\n", " "))  # there, a line feed is only white space
    return html.unescape(_TAG.sub(" ", source))


# Fixed phrases that start a quoted mail without quote marks, in the languages of the corpus.
_ORIGINAL = re.compile(
    r"^\s*(?:-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message original|message transféré|mensaje original|mensaje reenviado|исходное сообщение|пересылаемое сообщение|元のメッセージ|転送)[^\n]*|begin forwarded message.*)$",
    re.I,
)
_RULED = re.compile(r"^\s*-{3,}\s*[^-\s][^-\n]*-{3,}\s*$")
_ATTRIBUTION = re.compile(r"^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|.*\bпишет|.*\bнаписал\(?а?\)?|.*\bwrote|(?:\w{3}, )?\d{1,2} \w{3} \d{4} \d\d:\d\d.*|.*(?:のメール|は書きました|さんは書きました|が書きました))\s*[:：]\s*$", re.I)
_QUOTED_HEAD = re.compile(r"^\s*\*?(?:from|von|de|от|от кого|差出人)\*?\s*[:：]\s*\S", re.I)
_QUOTED_NEXT = re.compile(r"^\s*\*?(?:sent|date|gesendet|datum|envoyé|fecha|enviado|отправлено|дата|送信日時|日付|to|an|à|para|кому|宛先|subject|betreff|objet|asunto|тема|件名|cc)\*?\s*[:：]", re.I)
_SIGNATURE = re.compile(r"^--\s?$")
_ADDRESS = re.compile(r"[^\s@|]+@[^\s@|]+")


# Closing phrases before a sender's name (fixed values).
_CLOSING = re.compile(
    r"^\s*(?:cheers|thanks|thank you|best|best wishes|(?:kind |best |warm )?regards|yours|sincerely|yours sincerely|viele grüße|beste grüße|schöne grüße|mit freundlichen grüßen|freundliche grüße|gruß|bien à vous|cordialement|bien cordialement|salutations|un saludo|saludos|atentamente|un cordial saludo|с уважением|всего доброго|よろしくお願いいたします|よろしくお願いします|敬具)\s*[,.!。、]?\s*$",
    re.I,
)


def _is_contact(line: str) -> bool:
    """A contact line: few fields between bars, one of them an address and each of the others a short name."""
    fields = [f.strip() for f in line.split("|")]
    return 2 <= len(fields) <= 5 and any(_ADDRESS.fullmatch(f) for f in fields) and all(len(f.split()) <= 4 for f in fields)


def _signed_off(lines: list[str]) -> set[int]:
    """Numbers of the lines of the last closing, of up to two short lines after it, and of one contact line."""
    last = next((i for i in reversed(range(len(lines))) if _CLOSING.match(lines[i])), None)
    found = set() if last is None else {last}
    after = [] if last is None else [i for i in range(last + 1, len(lines)) if lines[i].strip()][:2]
    for i in after:
        if not (_is_contact(lines[i]) or len(lines[i].split()) < 6):
            break
        found.add(i)
    contact = next((i for i in reversed(range(len(lines))) if "@" in lines[i] and _is_contact(lines[i])), None)
    return found | ({contact} - {None})


def own_lines(text: str) -> list[str]:
    """Lines of a text part that its sender wrote: up to a signature or a quoted mail, without quoted lines and the closing with the names after it.

    Nothing is left out for its length; a disclaimer stays, it is told apart by its words later.
    """
    lines = text.split("\n")
    out: list[str] = []
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            out.append(line)
            continue
        first = bare[0]
        if first == ">":
            continue
        if first == "-" or first in "Bb":
            if _SIGNATURE.match(line):
                break
            if _ORIGINAL.match(line) or (_RULED.match(line) and any(_QUOTED_HEAD.match(x) for x in lines[i + 1 : i + 3])):
                break
        if ":" in bare or "：" in bare:
            if _QUOTED_HEAD.match(line) and _QUOTED_NEXT.match(next((x for x in lines[i + 1 : i + 4] if x.strip()), "")):
                break
            if bare[-1] in ":：" and _ATTRIBUTION.match(line):
                following = [x for x in lines[i + 1 : i + 4] if x.strip()]
                if not following or any(x.lstrip().startswith(">") for x in following):
                    continue
                break  # quoted without marks: all that follows is the earlier mail
        out.append(line)
    gone = _signed_off(out)
    return [line for i, line in enumerate(out) if i not in gone] if gone else out
