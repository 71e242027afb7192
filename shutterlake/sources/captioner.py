"""Captions by a model that a local server runs; pictures are scaled down before they are sent."""

from __future__ import annotations

import base64
import io
import json
import os
import urllib.request
from collections.abc import Callable

from shutterlake.functions import handlers
from shutterlake.options import CaptionOptions
from shutterlake.sources import contents

IMAGE_PROMPT = "Say in one short sentence what this picture shows."
VIDEO_PROMPT = "Say in one short sentence what the video shows that these {n} pictures were taken from, at even distances and in order."
_REGISTERED: list[bool] = []


def register_heif() -> bool:
    """Lets PIL read HEIC pictures where the plugin for it is installed; asking again changes nothing."""
    if not _REGISTERED:
        try:
            import pillow_heif

            pillow_heif.register_heif_opener()
            _REGISTERED.append(True)
        except ImportError:
            _REGISTERED.append(False)
    return _REGISTERED[0]


def jpeg_payload(picture: bytes, longest_edge: int, quality: int) -> bytes:
    """The picture as an RGB JPEG whose longer edge is at most `longest_edge`."""
    from PIL import Image

    register_heif()
    image = Image.open(io.BytesIO(picture)).convert("RGB")
    most = max(image.size)
    if most > longest_edge:
        image = image.resize(tuple(max(1, x * longest_edge // most) for x in image.size))
    out = io.BytesIO()
    image.save(out, "JPEG", quality=quality)
    return out.getvalue()


def _request(url: str, body: dict | None, timeout: float) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as answer:
        return json.load(answer)


def has_model(installed: list[str], wanted: str) -> bool:
    """Whether a model is there under its full name or the part before the colon."""
    return any(wanted in (n, n.split(":", 1)[0]) for n in installed)


def require_model(o: CaptionOptions = CaptionOptions()) -> None:
    """Refuses to begin without the server or without the model."""
    try:
        installed = [m["name"] for m in _request(f"{o.server}/api/tags", None, 10)["models"]]
    except OSError as e:
        raise RuntimeError(f"no model server at {o.server}: {e}") from e
    if not has_model(installed, o.model):
        raise RuntimeError(f"the server has no model {o.model}; it has {', '.join(installed) or 'none'}")


def chat(prompt: str, pictures: list[bytes], o: CaptionOptions = CaptionOptions()) -> str | None:
    """The model's answer, None if it is empty."""
    message = {"role": "user", "content": prompt, "images": [base64.b64encode(p).decode() for p in pictures]}
    answer = _request(f"{o.server}/api/chat", {"model": o.model, "messages": [message], "stream": False}, o.timeout_seconds)
    return (answer.get("message", {}).get("content") or "").strip() or None


def describer(home: str, o: CaptionOptions = CaptionOptions(), payload: Callable[[bytes, int, int], bytes] = jpeg_payload) -> Callable[[str], str | None]:
    """describe(filename) for commands.caption(): one picture of an image, several of a video."""

    def describe(filename: str) -> str | None:
        path, ext = os.path.join(home, filename), os.path.splitext(filename)[1].lower()
        if ext in handlers.IMAGES:
            with open(path, "rb") as f:
                pictures, prompt = [f.read()], IMAGE_PROMPT
        elif ext in handlers.VIDEOS:
            pictures = contents.video_frames(path, o.video_frames)
            prompt = VIDEO_PROMPT.format(n=len(pictures))
        else:
            raise RuntimeError(f"{filename} is no picture and no video")
        return chat(prompt, [payload(p, o.longest_edge, o.quality) for p in pictures], o)

    return describe
