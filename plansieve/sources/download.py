"""Archives of precinct files from the web, unpacked beside the loaders' folders. Runs on the driver, before any Spark job."""

from __future__ import annotations

import logging
import os
import shutil
import tempfile
import urllib.request
import zipfile

log = logging.getLogger(__name__)


def fetch(url: str | None, folder: str, timeout: float = 120.0) -> bool:
    """Downloads a file into a folder and unpacks it if it is a zip; nothing is done where a .shp is there already.

    Files keep their names but not their folders, so an archive can't write elsewhere. Without a url
    the place must be filled by hand: the folder is made, and False returned.
    """
    os.makedirs(folder, exist_ok=True)
    if any(n.lower().endswith(".shp") for n in os.listdir(folder)):
        return True
    if not url:
        log.warning("put the files into %s by hand", folder)
        return False
    with tempfile.NamedTemporaryFile() as part:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            shutil.copyfileobj(answer, part)
        part.flush()
        if not zipfile.is_zipfile(part.name):
            shutil.copyfile(part.name, os.path.join(folder, os.path.basename(url.split("?")[0]) or "download"))
            return True
        with zipfile.ZipFile(part.name) as z:
            for entry in z.infolist():
                name = os.path.basename(entry.filename)
                if name and not entry.is_dir():
                    with z.open(entry) as source, open(os.path.join(folder, name), "wb") as out:
                        shutil.copyfileobj(source, out)
    return True


def fetch_all(sources: dict[str, str | None], folder: str) -> dict[str, bool]:
    """state -> whether its folder is filled; a download that fails is logged and does not stop the others."""
    done = {}
    for state, url in sources.items():
        try:
            done[state] = fetch(url, os.path.join(folder, state))
        except OSError:
            log.exception("%s failed", url)
            done[state] = False
    return done
