"""Payload rewriting for replay: links, headers, styles, scripts, manifests, pages."""
