"""Names, lists, constants and prompt wording that results depend on.

Everything here is a plain value, kept in one place.  Nothing is computed from
data and nothing else in the package repeats these values.
"""

# --- corpus constants ------------------------------------------------------
TEXT_BUDGET = 2**23          # bytes of text kept per (dataset, month)
BYTE_BUDGET = 2**20          # bytes kept per (dataset, month) for image and audio
CONTEXT_SIZE = 2048          # default window, in tokens
STRIDE = 512                 # default step of overlapping windows
PROBABILITY_FLOOR = 1e-32    # p is clamped from below before log2
CDF_BITS = 30                # integer CDFs span [0, 2**30]
SHUFFLE_SEED = 42

NEWS_ARTICLES = 1000         # articles per month
WIKI_SENTENCES = 80          # sentences per article
ARXIV_SECTIONS = 2           # sections per paper
MATH_QUESTIONS = 500         # questions per month
CODE_LINES = 500             # longest run of lines taken from a code file
PATCH_HEIGHT, PATCH_WIDTH = 32, 64
AUDIO_CHUNK_BYTES = 2**16
AUDIO_CHUNKS_PER_FILE = 50

FIRST_MONTH, LAST_MONTH = "2017-01", "2023-11"
TEST_YEAR_START = "2023-01"
REPAIR_MONTH = "2021-03"
COVERAGE_MONTHS = 75
SMOOTHING_ALPHA = 0.3

# --- dataset catalogue: name, modality, unit recipe ------------------------
DATASETS = [
    ("bbc_news", "text", "news"),
    ("wikitext", "text", "wiki"),
    ("bbc_image", "image", "image"),
    ("code", "text", "code"),
    ("arxiv", "text", "arxiv"),
    ("audio", "audio", "audio"),
    ("math", "text", "math"),
]

# --- model names -----------------------------------------------------------
CODECS = ["flac", "gzip", "png", "zlib"]
EXCLUDED_MODELS = ["LLaMA-7B", "Llama-2-7B"]

MODEL_LABELS = {
    "Baichuan2-7B-Base": "Baichuan2-7B",
    "internlm-7B": "Internlm-7B",
    "Qwen-7B": "Qwen-7B",
    "Yi-6B": "Yi-6B",
    "chatglm3-6b-base": "Chatglm3-6B",
    "Mistral-7B": "Mistral-7B",
    "LLaMA-7B-HF": "LLaMA-7B",
    "LLaMA-13B": "LLaMA-13B",
    "Llama-2-13B": "Llama-2-13B",
    "Llama-2-7B-HF": "Llama-2-7B",
    "CodeLlama-7B": "CodeLlama-7B",
    "Llama-2-70B": "Llama-2-70B",
    "LLaMA-30B": "LLaMA-30B",
    "LLaMA-65B": "LLaMA-65B",
    "Yi-34B-200K": "Yi-34B",
    "Qwen1.5-7B": "Qwen1.5-7B",
    "gemma-7b": "Gemma-7B",
    "flac": "Flac",
    "png": "Png",
    "zlib": "Zlib",
}

LLAMA_FAMILY = [
    "Llama-2-7B-HF", "LLaMA-7B-HF", "LLaMA-13B", "Llama-2-13B",
    "CodeLlama-7B", "Llama-2-70B", "LLaMA-30B", "LLaMA-65B",
]
LARGE_TAGS = ["13b", "34b", "70b", "65b"]
LONG_CONTEXT_FAMILIES = [
    "Baichuan2", "Mistral", "Llama", "LLaMA", "Yi", "chatglm3", "gemma", "Qwen", "Qwen1.5",
]
HIDDEN_LABELS = [
    "Internlm-7B", "Chatglm3-6B", "LLaMA-7B", "LLaMA-13B", "Llama-2-13B",
    "Yi-34B", "LLaMA-65B", "CodeLlama-7B", "Qwen-7B", "Llama-2-70B",
]
LONG_CONTEXT_HIDDEN = ["LLaMA"]
CODE_MODEL_TASKS = ["code", "math", "bbc_image"]
TOKENIZER_MODELS = ["Mistral-7B", "Llama-2-7B-HF", "Baichuan2-7B-Base", "Qwen-7B", "chatglm3-6b-base"]

CONTEXT_VARIANTS = ["2K", "2K+SW", "4K", "8K"]
TABLE_TASKS = ["Wikitext", "BBC News", "Code", "Arxiv", "Image", "Audio"]

# --- prompt wording --------------------------------------------------------
NEWS_QUESTION_PROMPT = (
    "Title: {title}\n\nDate: {published_date}\nTLDR\n{description}\nMain Context:\n{content}\n\n========\n\n"
    "What's the key information in this article? I am making some quiz questions with short and quick answers. "
    "Help me find the key information, including but not limited to who, what, where, and when. "
    "For each key piece of information, ask a corresponding question next to the answer. "
    "Returns up to three QA pairs as a json dictionary list."
    "Here is a demonstration of how your output should look like:\n"
    '[\n{\n    "question": "Who has Stoke City signed?",\n    "answer": "Saido Berahino"\n},\n'
    '{\n    "question": "From which club has Stoke City signed Saido Berahino?",\n    "answer": "West Brom"\n},\n'
    '{\n    "question": "What is the fee Stoke City paid for Saido Berahino?",\n    "answer": "£12m"\n}\n]'
)

WIKI_QUESTION_PROMPT = (
    "Title: {title}\n\nMain Context:\n{content}\n\n========\n\n"
    "What's the key but rare knowledge in this article? I am making some quiz questions with short and quick answers. "
    "Help me find the key and rare knowledge in this article, but try to focus on information that is simple and "
    "concise (so the answer can be as short as possible). "
    "For each key piece of information, ask a corresponding question next to the answer. "
    "Remember, the question should include enough context to make the question answerable. "
    "Returns up to five QA pairs as a json dictionary list."
    "Here is a demonstration of how your output should look like:\n"
    '[\n{\n"question": "Who was Victoria\'s first cousin whom she married in 1840?",\n'
    '"answer": "Her first cousin, Prince Albert of Saxe-Coburg and Gotha."\n},\n'
    '{\n"question": "What was Victoria\'s nickname due to her children\'s marriages into various European royal '
    'families?",\n"answer": "\'The grandmother of Europe\'."\n},\n'
    '{\n"question": "How many children did Victoria and Albert have together?",\n"answer": "Nine children."\n},\n'
    '{\n"question": "What title did Victoria adopt in addition to Queen of the United Kingdom in 1876?",\n'
    '"answer": "Empress of India."\n}\n]'
)

ANSWERABLE_PROMPT = (
    'Is the following quiz question answerable? You should answer "Yes" or "No" as your answer, and nothing else. '
    'Unless significant information is missing in the question, you should reply "yes". Question: {question}'
)

ANSWER_PROMPTS = {
    "meta-llama/Llama-2-7b-hf": "Question: {question}\nAnswer: ",
    "meta-llama/Llama-2-7b-chat-hf": "[INST] {question} [/INST]",
    "meta-llama/Meta-Llama-3-8B": "Question: {question}\nAnswer: ",
    "meta-llama/Meta-Llama-3-8B-Instruct": (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{question}<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\n"
    ),
}

GPT4_JUDGE_PROMPT = (
    "The question is: {question}. And its reference answer is {ref_answer}. "
    "Now, your job is to judge whether the following answer is correct? Student answer: {out} "
    'You should only reply "Yes" or "No" as your answer and return nothing else.'
)

FACT_JUDGE_PROMPTS = {
    "meta-llama/Meta-Llama-3-8B-Instruct": (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"
        'Here is a question: "{question}". And its reference answer is "{ref_answer}". '
        "Now, your job is to judge whether the following student answer contains the reference answer? "
        "Student answer: {out} "
        'You should reply "Yes" if the student answer includes reference answer; otherwise reply "No". '
        'Return only "Yes" or "No" as your judgement and return nothing else. '
        "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
    ),
    "gpt-4": GPT4_JUDGE_PROMPT,
}

KNOWLEDGE_JUDGE_PROMPTS = {
    "meta-llama/Meta-Llama-3-8B-Instruct": (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"
        'Here is a question: "{question}". And its reference answer is "{ref_answer}". '
        "Now, your job is to judge whether the following student answer contains the reference answer? "
        'Student answer is: "{out}" '
        'You should reply "Yes" if the student answer includes reference answer; otherwise reply "No". '
        'Return only "Yes" or "No" as your judgement and return nothing else. '
        "<|eot_id|><|start_header_id|>assistant<|end_header_id|> My answer is: "
    ),
    "gpt-4": GPT4_JUDGE_PROMPT,
}

CODE_LINE_PROMPT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{last_line}\n\n"
    'Is the above line real code or just comment? Reply "Yes" if it\'s code, reply "No" if it\'s comment '
    "(for example has # or // at the begining). "
    "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
)

CODE_JUDGE_PROMPTS = {
    "meta-llama/Meta-Llama-3-8B-Instruct": (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"
        'Here are a line of code: the reference code A. "{ref_answer}"; and the student code B. "{out}". '
        "Now, your job is to judge whether the student answer (B) reflect the reference answer (A)? "
        'You should reply "Yes" if the student answer make sense according to the reference answer; '
        'otherwise reply "No". '
        'Return only "Yes" or "No" as your judgement and return nothing else. '
        "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
    ),
    "gpt-4": GPT4_JUDGE_PROMPT,
}

BATCH_JUDGE_PROMPT = (
    'Here is a question: "{question}". And its reference answer is "{ref_answer}". '
    'Now, your job is to judge whether the following answer is correct? Student answer: "{out}". '
    'You should reply "Yes" or "No" as your judgement and return nothing else.'
)
BATCH_METHOD = "POST"
BATCH_URL = "/v1/chat/completions"
BATCH_MODEL = "gpt-3.5-turbo-0125"
BATCH_MAX_TOKENS = 8

HINT_TOKENS = 3              # tokens of the target line that stay in the prompt
TARGET_MIN_TOKENS = 12       # a target line has more tokens than this
PROMPT_TOKEN_BUDGET = 2048
BLOCK_LINES, BLOCK_MIN_LINES, BLOCK_RESERVE = 100, 120, 110
TEXT_CUT_TOKENS = 3072
QUIZ_EXAMPLES, KNOWLEDGE_EXAMPLES, CODE_EXAMPLES = 100, 50, 400
