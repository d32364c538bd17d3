from layerstack.sources.features import read_features, write_libsvm
from layerstack.sources.weights import export_text, import_text, text_lines

__all__ = ["export_text", "import_text", "read_features", "text_lines", "write_libsvm"]
