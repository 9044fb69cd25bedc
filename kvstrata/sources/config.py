"""Settings of a store, with presets."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20


@dataclass(frozen=True)
class Config:
    """memtable_size: bytes of buffered writes that end a generation; sync_writes: each write is a generation at once.

    compaction_threshold, max_compaction: generations that start a compaction, and that one merges; compaction_enabled
    false switches it off, auto_compaction true starts it after writes. block_size: bytes of a Parquet page.
    compression: zstd or none. verify_checksums: readers check the checksums of pages. worker_threads: files of a
    generation written from a batch; frames follow Spark's partitioning instead.
    """

    memtable_size: int = 4 * MIB
    compaction_threshold: int = 4
    max_compaction: int = 8
    block_size: int = 4 << 10
    sync_writes: bool = True
    compression: bool = True
    verify_checksums: bool = True
    worker_threads: int = 2
    compaction_enabled: bool = True
    auto_compaction: bool = False

    def __post_init__(self):
        for name in ("memtable_size", "block_size", "worker_threads"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be > 0")

    def write_options(self) -> dict[str, str]:
        return {"compression": "zstd" if self.compression else "none", "parquet.page.size": str(self.block_size), "parquet.page.write-checksum.enabled": "true"}

    def read_options(self) -> dict[str, str]:
        return {"parquet.page.verify-checksum.enabled": str(self.verify_checksums).lower()}

    @classmethod
    def high_throughput(cls) -> Config:
        return cls(memtable_size=64 * MIB, compaction_threshold=16, max_compaction=32, block_size=64 << 10, sync_writes=False, compression=False, verify_checksums=False, worker_threads=4)

    @classmethod
    def low_memory(cls) -> Config:
        return cls(memtable_size=MIB, compaction_threshold=2, block_size=2 << 10, worker_threads=1)

    @classmethod
    def ultra(cls) -> Config:
        return cls(memtable_size=128 * MIB, compaction_threshold=32, max_compaction=64, block_size=128 << 10, sync_writes=False, compression=False, verify_checksums=False, worker_threads=4)
