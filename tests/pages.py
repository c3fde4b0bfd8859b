"""What the paged source fetches from and the chunked writer sends to in tests."""

import json
from pathlib import Path

from soukspark.sources.paged import Blocked

def fetch(key, page, size, options):
    """Shop a has two pages and half a third, which repeats an item of the second; b fails on its second; c is empty; after
    d's first page comes a login."""
    pages = {"a": [size, size, size // 2, 0], "b": [size, None], "c": [0], "d": [1, "login"]}[key]
    n = pages[page]
    if n is None:
        raise TimeoutError
    if n == "login":
        raise Blocked
    return [{"item_basic": {"itemid": page * size + k - (page == 2 and k == 0), "name": f"{key}{k}", "price": 250000, "item_rating": {"rating_star": 4.5, "rating_count": [7, 1]}, "sold": 3}} for k in range(n)]


def ratings(key, page, size, options):
    pages = {"full": 9, "few": 1, "none": 0, "blocked": 0, "late": 1}[key]
    if key == "blocked":
        raise Blocked
    if page >= pages:
        if key == "late":
            raise TimeoutError
        return []
    return [{"images": [f"{key}{page}-{k}", None, f"{key}{page}-{k}"], "videos": [{"cover": f"v{page}-{k}?x=1"}, {}]} for k in range(size)]


def flaky(key, page, size, options):
    """Fails on the second page until a file says that the source is well."""
    if page == 1 and not (Path(options["folder"]) / "well").exists():
        raise OSError("not now")
    return fetch("a", page, size, options)


def insert(rows, options):
    """One file a row, named by its key; a row that is there is ignored. The third chunk of a first run fails half-way."""
    folder, new = Path(options["folder"]), 0
    with open(folder / "calls", "a") as f:
        f.write(f"{len(rows)}\n")
    for k, r in enumerate(rows):
        if not (folder / "well").exists() and k == len(rows) // 2 and any(x["id"] % 400 == 0 for x in rows):
            raise ConnectionError("half of a chunk was sent")
        try:
            with open(folder / f"row-{r['listing_url']}-{r['account']}", "x") as f:
                json.dump(r, f)
            new += 1
        except FileExistsError:
            pass
    return new


def report(totals, options):
    (Path(options["folder"]) / "report").write_text(json.dumps(totals))
