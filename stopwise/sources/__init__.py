"""Raw drops, their manifests and the normalizers of landed feeds."""
