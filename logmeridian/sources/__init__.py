"""Where rows come from and go to: table scans, decoders, archives, sinks."""
