"""Documents written by the driver: JSON, a hashed manifest, an HTML report."""

from __future__ import annotations

import hashlib
import json
from html import escape
from pathlib import Path


def write_json(path, payload, sort_keys: bool = False) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload, indent=2, sort_keys=sort_keys, default=str), encoding="utf-8")
    return path


def canonical_json(payload) -> str:
    """Sorted keys, no spaces; NaN and infinities raise ValueError."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False)


def write_manifest(path, payload) -> dict:
    """Writes {payload, schema_version, sha256}; the hash is of the payload's canonical JSON, whatever its key order."""
    manifest = {"schema_version": 1, "sha256": hashlib.sha256(canonical_json(payload).encode()).hexdigest(), "payload": payload}
    write_json(path, manifest, sort_keys=True)
    return manifest


STYLE = "body{font-family:sans-serif;max-width:60rem;margin:2rem auto}table{border-collapse:collapse}td,th{padding:.4rem .8rem;border-bottom:1px solid #ccc;text-align:left}"
COLUMNS = (("MAE", "mae", "{:.5f}"), ("RMSE", "rmse", "{:.5f}"), ("Direction", "directional_accuracy", "{:.1%}"), ("Strategy Sharpe", "strategy_sharpe", "{:.2f}"), ("Net return", "net_cumulative_return", "{:.1%}"))


def render_report(result: dict, output) -> Path:
    """A table of models and the bootstrap comparison, as one static page; names are escaped."""
    synthetic = result.get("dataset", {}).get("kind", "").startswith("deterministic_synthetic")
    head = "".join(f"<th>{h}</th>" for h in ("Model", *(c[0] for c in COLUMNS)))
    body = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in (escape(name), *(form.format(m[key]) for _, key, form in COLUMNS))) + "</tr>" for name, m in result["models"].items())
    compared = [(k, v) for k, v in result.items() if k.endswith("_mae_bootstrap")]
    boxes = "".join(
        f"<h2>{escape(k.removesuffix('_mae_bootstrap').replace('_', ' '))}</h2><p>Observed MAE difference: {v['observed_mae_difference']:.6f}</p>"
        f"<p>Bootstrap 90% interval: [{v['bootstrap_p05']:.6f}, {v['bootstrap_p95']:.6f}] (block size {v['block_size']}); below 0 the first is better.</p>"
        for k, v in compared
    )
    kind = "Synthetic" if synthetic else "Historical"
    page = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Walk-forward report</title><style>{STYLE}</style></head><body><h1>Walk-forward report</h1><p>{kind} data; not investment advice.</p><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{boxes}</body></html>'
    path = Path(output)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(page, encoding="utf-8")
    return path
