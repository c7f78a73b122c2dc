"""Extractors that run a model. Each needs a runtime that is imported when the extractor is made, once in each worker.

Where the runtime is missing, making the extractor raises and says what is needed; any of them can be registered anew.
"""

from __future__ import annotations

import importlib
import io
import os
from collections.abc import Iterable, Iterator
from tempfile import NamedTemporaryFile

import numpy as np

from korvex.functions.extract import Extractor, Feature, address, register_extractor

SCENE_CHANGE = 0.4  # Bhattacharyya distance of the colour histograms of neighbouring frames


def unit(rows) -> list[list[float]]:
    """Rows of unit length; a row of zeros stays."""
    x = np.asarray(rows, np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).tolist()


class ModelExtractor(Extractor):
    """Imports what `needs` names as attributes, then loads the weights named by `weights`."""

    name = weights = ""
    needs: dict[str, str] = {}

    def __init__(self, weights: str | None = None, device: str | None = None) -> None:
        missing = []
        for attribute, module in self.needs.items():
            try:
                setattr(self, attribute, importlib.import_module(module))
            except ImportError:
                missing.append(module)
        if missing:
            raise RuntimeError(f"extractor {self.name!r} needs {', '.join(missing)}; install it or register your own under this name")
        self.weights = weights or self.weights
        torch = getattr(self, "torch", None)
        self.device = device or ("cuda" if torch is not None and torch.cuda.is_available() else "cpu")
        self.load()

    def load(self) -> None:
        raise NotImplementedError

    def uri(self, kind: str) -> str:
        return address(self.name, 1, kind)

    def extract(self, content: bytes, kind: str) -> list[Feature]:
        return self.extract_batch([(content, kind)])[0]

    def picture(self, content: bytes):
        return self.pil.open(io.BytesIO(content)).convert("RGB")

    def sound(self, content: bytes) -> tuple[np.ndarray, int]:
        """Samples of one channel, and their rate."""
        samples, rate = self.soundfile.read(io.BytesIO(content))
        return (samples.mean(axis=1) if samples.ndim > 1 else samples), rate


@register_extractor("e5_large")
class PassageText(ModelExtractor):
    """Mean of the token vectors of a passage, of unit length."""

    name, weights, needs = "e5_large", "intfloat/e5-large-v2", {"torch": "torch", "hub": "transformers"}
    prefix, most_tokens = "passage: ", 512

    def load(self) -> None:
        self.tokenizer = self.hub.AutoTokenizer.from_pretrained(self.weights)
        self.model = self.hub.AutoModel.from_pretrained(self.weights).to(self.device).eval()

    def extract_batch(self, items: Iterable[tuple[bytes, str]]) -> list[list[Feature]]:
        texts = [c.decode("utf-8", "replace") for c, _ in items]
        given = self.tokenizer([self.prefix + t for t in texts], padding=True, truncation=True, max_length=self.most_tokens, return_tensors="pt").to(self.device)
        with self.torch.no_grad():
            state = self.model(**given).last_hidden_state.float().cpu().numpy()
        real = given["attention_mask"].cpu().numpy()[..., None]
        return [[Feature(self.uri("embedding"), v, t)] for t, v in zip(texts, unit((state * real).sum(1) / real.sum(1)))]


@register_extractor("bge_m3")
class LexicalText(ModelExtractor):
    """A dense vector, and the weights of a text's tokens as a sparse one."""

    name, weights, needs = "bge_m3", "BAAI/bge-m3", {"flag": "FlagEmbedding"}

    def load(self) -> None:
        self.model = self.flag.BGEM3FlagModel(self.weights, use_fp16=False)

    def extract_batch(self, items: Iterable[tuple[bytes, str]]) -> list[list[Feature]]:
        texts = [c.decode("utf-8", "replace") for c, _ in items]
        got = self.model.encode(texts, return_dense=True, return_sparse=True)
        out = []
        for t, v, weights in zip(texts, np.asarray(got["dense_vecs"]).tolist(), got.get("lexical_weights") or [{}] * len(texts)):
            own = [Feature(self.uri("embedding"), v, t)]
            if weights:
                own.append(Feature(self.uri("sparse"), text=t, sparse={int(k): float(x) for k, x in weights.items()}))
            out.append(own)
        return out


class Picture(ModelExtractor):
    """One vector of unit length a picture."""

    needs = {"torch": "torch", "hub": "transformers", "pil": "PIL.Image"}

    def load(self) -> None:
        self.processor = self.hub.AutoProcessor.from_pretrained(self.weights)
        self.model = self.hub.AutoModel.from_pretrained(self.weights).to(self.device).eval()

    def vectors(self, given):
        return self.model.get_image_features(**given)

    def extract_batch(self, items: Iterable[tuple[bytes, str]]) -> list[list[Feature]]:
        items = list(items)
        given = self.processor(images=[self.picture(c) for c, _ in items], return_tensors="pt").to(self.device)
        with self.torch.no_grad():
            rows = unit(self.vectors(given).float().cpu().numpy())
        return [[Feature(self.uri("embedding"), v, metadata={"content_type": k})] for (_, k), v in zip(items, rows)]


@register_extractor("siglip")
class Siglip(Picture):
    name, weights = "siglip", "google/siglip-so400m-patch14-384"


@register_extractor("clip")
class Clip(Picture):
    name, weights = "clip", "openai/clip-vit-large-patch14"


@register_extractor("dinov2")
class Dinov2(Picture):
    """The vector of the whole picture is the model's first token."""

    name, weights = "dinov2", "facebook/dinov2-base"

    def load(self) -> None:
        self.processor = self.hub.AutoImageProcessor.from_pretrained(self.weights)
        self.model = self.hub.AutoModel.from_pretrained(self.weights).to(self.device).eval()

    def vectors(self, given):
        return self.model(**given).last_hidden_state[:, 0]


@register_extractor("arcface")
class Faces(ModelExtractor):
    """A vector for each face that is found, with its box and the finder's score."""

    name, weights, needs, least = "arcface", "buffalo_l", {"insightface": "insightface", "pil": "PIL.Image"}, 0.5

    def load(self) -> None:
        self.app = self.insightface.app.FaceAnalysis(name=self.weights, providers=["CUDAExecutionProvider", "CPUExecutionProvider"])
        self.app.prepare(ctx_id=0, det_thresh=self.least)

    def extract_batch(self, items: Iterable[tuple[bytes, str]]) -> list[list[Feature]]:
        out = []
        for content, kind in items:
            found = self.app.get(np.array(self.picture(content)))
            out.append([Feature(self.uri("embedding"), np.asarray(f.embedding).tolist(), metadata={"face_index": str(n), "bbox": str(np.asarray(f.bbox).tolist()), "det_score": str(float(f.det_score)), "content_type": kind}) for n, f in enumerate(found)])
        return out


@register_extractor("whisper")
class Transcript(ModelExtractor):
    """What is said, with the length of the sound; no vector."""

    name, weights, needs = "whisper", "openai/whisper-large-v3", {"torch": "torch", "hub": "transformers", "soundfile": "soundfile"}

    def load(self) -> None:
        self.processor = self.hub.AutoProcessor.from_pretrained(self.weights)
        self.model = self.hub.AutoModelForSpeechSeq2Seq.from_pretrained(self.weights).to(self.device).eval()

    def extract_batch(self, items: Iterable[tuple[bytes, str]]) -> list[list[Feature]]:
        out = []
        for content, kind in items:
            samples, rate = self.sound(content)
            given = self.processor(samples, sampling_rate=rate, return_tensors="pt", return_attention_mask=True).to(self.device)
            with self.torch.no_grad():
                said = self.processor.batch_decode(self.model.generate(**given, return_timestamps=True), skip_special_tokens=True)[0].strip()
            out.append([Feature(self.uri("transcript"), text=said, metadata={"sample_rate": str(rate), "duration_s": str(len(samples) / rate), "content_type": kind})])
        return out


@register_extractor("clap")
class Sound(ModelExtractor):
    """One vector of unit length a sound."""

    name, weights, needs = "clap", "laion/clap-htsat-unfused", {"torch": "torch", "hub": "transformers", "soundfile": "soundfile"}

    def load(self) -> None:
        self.processor = self.hub.AutoProcessor.from_pretrained(self.weights)
        self.model = self.hub.ClapModel.from_pretrained(self.weights).to(self.device).eval()

    def extract_batch(self, items: Iterable[tuple[bytes, str]]) -> list[list[Feature]]:
        out = []
        for content, kind in items:
            samples, rate = self.sound(content)
            given = self.processor(audios=samples, sampling_rate=rate, return_tensors="pt").to(self.device)
            with self.torch.no_grad():
                v = unit(self.model.get_audio_features(**given).float().cpu().numpy())[0]
            out.append([Feature(self.uri("fingerprint"), v, metadata={"duration_s": str(len(samples) / rate), "content_type": kind})])
        return out


def scenes(histograms: Iterable[np.ndarray], change: float = SCENE_CHANGE) -> Iterator[tuple[int, int]]:
    """(first frame, end) of each scene: a new one begins where neighbouring histograms are further apart than `change`."""
    begin = n = 0
    before = None
    for n, h in enumerate(histograms, 1):
        h = np.asarray(h, np.float64).ravel()
        if before is not None:
            scale = np.sqrt(before.sum() * h.sum())
            alike = np.sqrt(before * h).sum() / scale if scale else 1.0
            if np.sqrt(max(0.0, 1.0 - alike)) > change:
                yield begin, n - 1
                begin = n - 1
        before = h
    if n > begin:
        yield begin, n


@register_extractor("vertex_multimodal")
class Scenes(ModelExtractor):
    """A vector for the middle frame of each scene of a film, and the scenes' bounds; one vector for a picture."""

    name, weights = "vertex_multimodal", "multimodalembedding@001"
    needs = {"vision": "vertexai.vision_models", "cv2": "cv2", "pil": "PIL.Image"}

    def load(self) -> None:
        self.model = self.vision.MultiModalEmbeddingModel.from_pretrained(self.weights)

    def vector(self, picture: bytes) -> list[float]:
        return list(self.model.get_embeddings(image=self.vision.Image(image_bytes=picture)).image_embedding)

    def film(self, content: bytes) -> tuple[list[tuple[int, int]], list[bytes], float]:
        """Scenes by frame number, the middle frame of each as JPEG, and frames a second."""
        cv2 = self.cv2
        with NamedTemporaryFile(suffix=".mp4", delete=False) as f:  # the decoder reads from a file of this worker only
            f.write(content)
        try:
            film = cv2.VideoCapture(f.name)

            def histograms():
                while True:
                    ok, frame = film.read()
                    if not ok:
                        return
                    yield cv2.calcHist([cv2.cvtColor(frame, cv2.COLOR_BGR2HSV)], [0, 1], None, [50, 60], [0, 180, 0, 256])

            found, frames = list(scenes(histograms())), []
            for a, b in found:
                film.set(cv2.CAP_PROP_POS_FRAMES, (a + b) // 2)
                frames.append(cv2.imencode(".jpg", film.read()[1])[1].tobytes())
            return found, frames, film.get(cv2.CAP_PROP_FPS) or 30.0
        finally:
            os.unlink(f.name)

    def extract_batch(self, items: Iterable[tuple[bytes, str]]) -> list[list[Feature]]:
        out = []
        for content, kind in items:
            if not kind.startswith("video/"):
                out.append([Feature(self.uri("embedding"), self.vector(content), metadata={"content_type": kind})])
                continue
            found, frames, rate = self.film(content)
            ms = [(a / rate * 1000, b / rate * 1000) for a, b in found]
            own = [Feature(self.uri("scene_embedding"), self.vector(x), metadata={"scene_index": str(n), "start_ms": str(a), "end_ms": str(b)}, timestamp_ms=a) for n, (x, (a, b)) in enumerate(zip(frames, ms))]
            out.append([*own, Feature(self.uri("scene_boundaries"), metadata={"scene_count": str(len(ms)), "scenes": str([list(x) for x in ms])})])
        return out
