"""Plain files under a URI: a reader and a writer of bytes."""

from __future__ import annotations

from pyarrow import fs as pafs


class Reader:
    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.fs, self.root = pafs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def get(self, path: str) -> bytes:
        with self.fs.open_input_file(self._at(path)) as f:
            return f.read()

    def length(self, path: str) -> int:
        info = self.fs.get_file_info(self._at(path))
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(path)
        return info.size

    def _under(self, path: str, kind: pafs.FileType) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self._at(path), allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == kind)

    def list(self, path: str = "") -> list[str]:
        return self._under(path, pafs.FileType.File)

    def list_dirs(self, path: str = "") -> list[str]:
        return self._under(path, pafs.FileType.Directory)

    def subdir(self, path: str):
        return type(self)(f"{self.uri}/{path}")


class Writer(Reader):
    def set(self, path: str, data: bytes) -> None:
        """Written beside and moved into place, so that no reader sees a part."""
        at = self._at(path)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(f"{at}.part") as f:
            f.write(data)
        self.fs.move(f"{at}.part", at)

    def remove(self, path: str) -> None:
        self.fs.delete_file(self._at(path))

    def remove_directory(self, path: str = "") -> None:
        self.fs.delete_dir(self._at(path))
