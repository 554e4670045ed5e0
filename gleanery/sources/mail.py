"""Messages: headers, parts, and what they give away."""

from __future__ import annotations

import email
import email.policy
import re
from email.utils import getaddresses


def _base(domain: str) -> str:
    from gleanery.functions.dims import SHARED_SUFFIXES

    labels = domain.lower().rstrip(".").split(".")
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in SHARED_SUFFIXES else labels[-2:])


def _domain(value: str) -> str:
    found = getaddresses([value])
    return found[0][1].rpartition("@")[2].lower() if found else ""


def risk(name: str) -> str | None:
    from gleanery.functions.dims import POSED, RISKY

    parts = name.lower().split(".")
    kind = next((k for k, exts in RISKY.items() if len(parts) > 1 and parts[-1] in exts), None)
    return kind and kind + (f" as {parts[-2]}" if len(parts) > 2 and parts[-2] in POSED else "")


def read(d: bytes, f, root: int) -> None:
    m = email.message_from_bytes(d, policy=email.policy.default)
    head = d.find(b"\n\n") if b"\r\n\r\n" not in d else d.find(b"\r\n\r\n")
    f.node(root, "headers", 0, head if head >= 0 else len(d))
    get = lambda k: [str(v) for v in m.get_all(k, [])]
    received = get("received")[::-1]
    for h in received[:1]:
        at = re.findall(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", h)
        public = [a for a in at if not re.match(r"(10|127)\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.", a)]
        if public:
            f.fact("sentfrom", public[0], root)
        host = re.match(r"\s*from\s+([A-Za-z0-9._-]+)", h)
        if host and re.search(r"(?i)\.(local|lan|home)$|macbook|-pc$|^desktop-|^laptop-", host[1]):
            f.fact("computer", host[1], root)
    for k, kind in (("x-mailer", "mailer"), ("user-agent", "mailer")):
        for v in get(k)[:1]:
            f.fact(kind, v, root)
    for v in get("date")[:1]:
        z = re.search(r"([+-])(\d\d)(\d\d)\b", v)
        if z:
            f.fact("timezone", f"UTC{z[1]}{z[2]}:{z[3]}", root)
    for v in get("authentication-results"):
        for name, said in re.findall(r"\b(spf|dkim|dmarc)=(\w+)", re.sub(r"\([^()]*\)", "", v)):
            f.fact("authclaim", f"{name}={said}", root)
    sender = _domain((get("from") or [""])[0])
    for k, kind in (("reply-to", "replyto"), ("return-path", "returnpath")):
        for v in get(k)[:1]:
            other = _domain(v)
            if other and sender and _base(other) != _base(sender):
                f.fact(kind, v, root)
                if kind == "replyto":
                    f.problem("hidden", "replies go to another site", 0, 0)
    for part in m.walk():
        kind, name = part.get_content_type(), part.get_filename()
        c = f.node(root, kind, 0, 0, name)
        if name:
            f.fact("attachments", name, c)
            if risk(name):
                f.fact("riskyfile", f"{name}: {risk(name)}", c)
        elif kind == "text/html":
            body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
            sites = {}
            for href, words in re.findall(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["'][^>]*>(.*?)</a>""", body):
                to = re.match(r"(?i)https?://(?:[^/?#]*@)?([^/?#:]*)", href.strip())
                if not to:
                    continue
                host = to[1].lower().rstrip(".")
                sites.setdefault(host)
                said = re.fullmatch(r"(?i)\s*(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})(?:[/?#]\S*)?\s*", re.sub("<[^>]*>", "", words))
                if said and _base(said[1].lower().removeprefix("www.")) != _base(host):
                    f.fact("linkmismatch", f"{said[1]} goes to {host}", c)
                    f.problem("hidden", "a link goes elsewhere than it says", 0, 0)
                if "xn--" in host:
                    f.fact("linkidn", host, c)
            if sites:
                f.fact("weblinks", ", ".join(list(sites)[:4]) + (f" and {len(sites) - 4} more" if len(sites) > 4 else ""), c)
