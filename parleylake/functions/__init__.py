"""parleylake.functions"""
