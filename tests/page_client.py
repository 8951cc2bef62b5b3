"""A client of pages for tests: a folder says what there is, and every request leaves a file there."""

import json
import pathlib
import uuid


def get(params):
    folder = pathlib.Path(params["folder"])
    asked = f"{params['first']}@{params['startIndex']}" + ("?" if params.get("resultsPerPage") == 1 else "")
    before = len(list(folder.glob(f"{asked}#*")))
    (folder / f"{asked}#{uuid.uuid4().hex}").touch()
    broken = json.loads((folder / "broken.json").read_text()) if (folder / "broken.json").exists() else []
    if asked in broken:
        return 404, None
    if before == 0 and params["startIndex"] == 4:
        return 429, None  # the first time only
    total = int(params["first"][-2:])
    ids = list(range(params["startIndex"], min(params["startIndex"] + 4, total)))
    return 200, {"resultsPerPage": 4, "startIndex": params["startIndex"], "totalResults": total, "vulnerabilities": [{"cve": {"id": f"{params['first']}-{k}"}} for k in ids]}
