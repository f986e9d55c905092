"""figshelf: a catalogue of the figures and tables of document collections, on Spark."""
