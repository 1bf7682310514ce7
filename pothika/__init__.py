"""pothika: segmentation of digitised books into works and their linkage to a catalogue, on Spark."""
