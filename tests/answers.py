"""Transports over recorded answers; tasks import them by name."""

import json
import os

from quirelight.operators.fetching import Answer
from quirelight.sources.scans import Refused

ENTRY = '<div class="cp-publication"><h2 class="publication-title"><a href="/publication/p{0}">Title {0}</a></h2><p class="publication-authors">Ann Author <span class="publication-year">20{0:02d}</span></p></div>'
PAGES = {1: range(3), 2: range(2, 6), 3: range(6, 8), 5: range(10, 12)}  # page 4 fails, 2 repeats an entry of 1


def catalogue(address, body):
    if address.endswith("/gone"):
        raise Refused(404, address)
    page = body["data"]["paged"] if body else 1
    if page not in PAGES:
        raise Refused(500, address)
    html = "".join(map(ENTRY.format, PAGES[page]))
    told = "" if address.endswith("/plain") else '<script>window.FWP_JSON = {"preload_data": {"settings": {"pager": {"total_pages": 5}}}};</script>'
    return json.dumps({"template": html}) if body else f"<html>{told}{html}</html>"


def works(address, body):
    """Three pages, the second of them empty; every address is noted in the folder that it names."""
    base, _, query = address.partition("/works?")
    folder = base.removeprefix("file://")
    with open(f"{folder}/asked", "a") as log:
        log.write(query + "\n")
    if "A13" in query:
        raise Refused(500, address)
    if "A14" in query:  # fails once, then answers
        if not os.path.exists(f"{folder}/failed"):
            open(f"{folder}/failed", "w").close()
            raise Refused(404, address)
    cursor = query.partition("&cursor=")[2].partition("&")[0]
    work = lambda k: {"id": f"https://openalex.org/W{k}", "title": f"Work {k}", "publication_year": 2000 + k, "primary_location": {"version": "publishedVersion"}}
    pages = {"*": ([work(1), work(2)], "a="), "a=": ([], "b"), "b": ([work(3)], None)}
    results, following = pages[cursor]
    return json.dumps({"results": results, "meta": {"next_cursor": following}})


BODY = bytes(range(256)) * 40


def files(url, start):
    """What a server gives, by the url's last part."""
    name = url.rpartition("/")[2]
    head = {"content-type": "application/pdf"}
    whole = {**head, "content-length": str(len(BODY))}
    if name.startswith("missing"):
        return Answer(404, {}, iter(()))
    if name.startswith("busy"):
        return Answer(503, {}, iter(()))
    if name.startswith("small"):
        return Answer(200, head, iter([b"tiny"]))
    if name.startswith("broken") and not start:  # half of it, then the rest on asking again
        return Answer(200, whole, iter([BODY[: len(BODY) // 2]]))
    if name.startswith("norange") or not start:
        return Answer(200, whole, iter([BODY[:100], BODY[100:]]))
    if start >= len(BODY):
        return Answer(416, {"content-range": f"bytes */{len(BODY)}"}, iter(()))
    return Answer(206, {**head, "content-range": f"bytes {start}-{len(BODY) - 1}/{len(BODY)}", "content-length": str(len(BODY) - start)}, iter([BODY[start:]]))
