"""DataFrame operators over scanline, pixel, run and tile relations."""
