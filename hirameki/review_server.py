"""The review view over HTTP: pages of a cached table, with edits in an append-only log."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirameki.operators import review
from hirameki.sources import export_document, reviewed_root

LOG = "seq long, id long, caption string, reviewed boolean"
SHOWN = ("id", "image_id", "caption", "source_caption", "caption_replaced", "missing_tokens")
PAGE = """<!doctype html><meta charset="utf-8"><title>Review</title>
<p><label>Sort <select id="sort"></select></label> <select id="order"><option>asc<option>desc</select>
<label><input type="checkbox" id="missing_only">missing</label> <label><input type="checkbox" id="edited_only">edited</label> <label><input type="checkbox" id="unreviewed_only">unreviewed</label>
<button id="prev">&lt;</button> <span id="at"></span> <button id="next">&gt;</button> <button id="save">Save</button></p><div id="items"></div>
<script>
const $ = id => document.getElementById(id), post = (path, body) => fetch(path, {method: "POST", body: JSON.stringify(body)});
let meta, offset = 0;
const badge = (v, bad) => v === null || v === undefined || v === "" ? "na" : bad ? "bad" : "ok";
async function show() {
  const q = new URLSearchParams({offset, limit: meta.page_size, sort: $("sort").value, order: $("order").value});
  for (const f of ["missing_only", "edited_only", "unreviewed_only"]) q.set(f, $(f).checked ? 1 : 0);
  const page = await (await fetch("/api/items?" + q)).json();
  $("at").textContent = `${offset + 1}-${offset + page.items.length} / ${page.total}`;
  $("items").replaceChildren(...page.items.map(x => {
    const row = document.createElement("p"), text = document.createElement("input"), done = document.createElement("input"), info = document.createElement("span");
    text.value = x.caption_replaced ?? ""; text.size = 80; text.onchange = () => post("/api/update", {id: x.id, caption_replaced: text.value});
    done.type = "checkbox"; done.checked = x.reviewed; done.onchange = () => post("/api/reviewed", {id: x.id, reviewed: done.checked});
    const e = x.extra_fields;
    info.textContent = ` ${x.id} ${x.source_caption ?? ""} ${x.missing_tokens.join(" ")} fluency ${badge(e.lm_target_ppl, e.lm_target_ppl >= meta.fluency_threshold)} meaning ${badge(e.semantic_similarity, e.semantic_similarity <= meta.semantic_threshold)} `;
    row.append(done, text, info); return row;
  }));
}
const move = by => { offset = Math.max(0, offset + by * meta.page_size); show(); };
(async () => {
  meta = await (await fetch("/api/metadata")).json();
  for (const f of new Set(["id", "lm_ppl", "lm_source_ppl", "lm_target_ppl", "semantic_similarity", ...meta.fields])) $("sort").add(new Option(f));
  for (const f of ["sort", "order", "missing_only", "edited_only", "unreviewed_only"]) $(f).onchange = () => { offset = 0; show(); };
  $("prev").onclick = () => move(-1); $("next").onclick = () => move(1); $("save").onclick = () => post("/api/save", {});
  setInterval(() => post("/api/save", {}), 600000); show();
})();
</script>"""


class ReviewStore:
    """rows: index, id, caption and others, missing_tokens and reviewed; ids are unique. With ann (see review.opened) a save keeps its other fields. Edits are a person's, so their log is short."""

    def __init__(self, rows: DataFrame, root: dict[str, Any], output: str, page_size: int = 50):
        for name, kind in (("image_id", "long"), ("source_caption", "string"), ("caption_replaced", "string"), ("missing_tokens", "array<string>"), ("reviewed", "boolean")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        self.rows, self.root, self.output, self.page_size = rows.cache(), root, output, page_size
        self.log: list[tuple] = []
        self.lock = threading.Lock()
        self.fields = sorted(c for c in rows.columns if c not in (*review.BASE_FIELDS, "missing_tokens", "_edited", "index", "ann"))

    def now(self) -> DataFrame:
        with self.lock:
            log = list(self.log)
        return review.apply_edits(self.rows, self.rows.sparkSession.createDataFrame(log, LOG))

    def metadata(self) -> dict[str, Any]:
        fluency, meaning = (review.strictest((self.root.get(a) or {}).get(b)) for a, b in (("lm_fluency_scoring", "source_thresholds"), ("semantic_scoring", "similarity_thresholds")))
        return {"total": self.rows.count(), "page_size": self.page_size, "fields": self.fields, "fluency_threshold": fluency, "semantic_threshold": meaning}

    def items(self, offset: int, limit: int, sort: str = "id", descending: bool = False, **filters: bool) -> dict[str, Any]:
        found = review.filtered(self.now(), **filters)
        found = found if sort in found.columns else found.withColumn(sort, F.lit(None).cast("double"))
        shown = review.payload(review.page(found, offset, limit, sort, descending)).collect()  # a page
        items = [{**{k: r[k] for k in SHOWN}, "extra_fields": {k: r[k] for k in self.fields if r[k] is not None}, "edited": r["_edited"], "reviewed": r["reviewed"]} for r in shown]
        return {"total": found.count(), "items": items}

    def add(self, id_: Any, caption: str | None = None, reviewed: bool | None = None) -> bool:
        if self.rows.where(F.col("id") == F.lit(id_)).isEmpty():
            return False
        with self.lock:
            self.log.append((len(self.log), id_, caption, None if reviewed is None else bool(reviewed)))
        return True

    def save(self) -> None:
        rows = self.now()
        if "ann" in rows.columns:
            rows = review.saved(rows)
        else:
            rows = rows.select("index", F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("index", "_edited")]).alias("ann"))
        export_document(rows, reviewed_root(self.root), self.output)


class Handler(BaseHTTPRequestHandler):
    def reply(self, value: Any, status: int = 200) -> None:
        page = isinstance(value, str)
        self.send_response(status)
        self.send_header("Content-Type", f"{'text/html' if page else 'application/json'}; charset=utf-8")
        self.end_headers()
        self.wfile.write((value if page else json.dumps(value, ensure_ascii=False)).encode())

    def missing(self) -> None:
        self.send_response(404)
        self.end_headers()

    def do_GET(self) -> None:
        url, store = urlparse(self.path), self.server.store
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        if url.path == "/":
            self.reply(PAGE)
        elif url.path == "/api/metadata":
            self.reply(store.metadata())
        elif url.path == "/api/items":
            flags = {k: q.get(k) == "1" for k in ("missing_only", "edited_only", "unreviewed_only")}
            self.reply(store.items(int(q.get("offset", 0)), int(q.get("limit", store.page_size)), q.get("sort", "id"), q.get("order") == "desc", **flags))
        else:
            self.missing()

    def do_POST(self) -> None:
        try:
            data = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
        except ValueError:
            return self.reply({"error": "invalid json"}, 400)
        path, store = urlparse(self.path).path, self.server.store
        if path == "/api/save":
            store.save()
            return self.reply({"ok": True, "output": store.output})
        field = {"/api/update": ("caption_replaced", "caption"), "/api/reviewed": ("reviewed", "reviewed")}.get(path)
        if not field:
            return self.missing()
        if data.get("id") is None or data.get(field[0]) is None:
            return self.reply({"error": f"missing id or {field[0]}"}, 400)
        if not store.add(data["id"], **{field[1]: data[field[0]]}):
            return self.reply({"error": "id not found"}, 404)
        return self.reply({"ok": True})

    def log_message(self, *_: Any) -> None:
        """Requests aren't logged."""


def server(store: ReviewStore, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    found = ThreadingHTTPServer((host, port), Handler)
    found.store = store
    return found
