"""Readers and writers of waveform files, and adapters of other tables to the waveform shapes."""
