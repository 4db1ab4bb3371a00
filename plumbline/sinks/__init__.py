"""Writers: reports, caches, ignore lists."""
